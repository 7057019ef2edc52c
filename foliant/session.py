"""Session factory and the helpers every multi-stage job needs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "foliant", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; callers may override any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one where that is unset (single machine)."""
    there = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not there:
        if not re.match(r"local(\[|-cluster\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="foliant-shared-")
        atexit.register(shutil.rmtree, there, True)
        spark.conf.set("spark.checkpoint.dir", there)
    return there


#: Intermediate tables of this driver that haven't been dropped.
_WRITTEN: list[str] = []
#: Spark's own setting that deletes a job's shuffle files at its end, rather than when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, deleted by ``drop_intermediates``, at the latest when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_drop_at_exit, spark)
    _WRITTEN.append(path)
    return path


def write_tidily(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write a table whose shuffle files nobody needs again once it stands: they go with the end of the job."""
    spark = df.sparkSession
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once into the shared folder and read it back.

    This cuts the lineage, so a costly stage isn't computed again by each of its readers, and the rows survive a lost executor. The table stays
    until ``drop_intermediates``, at the latest until the session ends.
    """
    path = new_folder(df.sparkSession, name)
    write_tidily(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_intermediates(spark: SparkSession) -> int:
    """Deletes the intermediate tables written so far; call it when the results that read them have been written. Gives their number."""
    jvm, dropped = spark.sparkContext._jvm, 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        dropped += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return dropped


def _drop_at_exit(spark: SparkSession) -> None:
    try:
        drop_intermediates(spark)
    except Exception:  # the session may have been stopped before
        _WRITTEN.clear()


def scan_tasks(df: DataFrame) -> int:
    """About how many tasks the scan of ``df`` has, from its files and their size, without planning the query."""
    spark = df.sparkSession
    limit = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(len(df.inputFiles()), size // limit)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by key only if the scan has fewer tasks than the cluster has cores (few, small files before Python work)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if scan_tasks(df) >= cores else df.repartition(cores, *keys)
