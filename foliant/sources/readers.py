"""Readers and sinks for pages, benchmark results and judged corpora."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

PAGE = "page_num INT, markdown STRING, backend STRING, bbox_data ARRAY<STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE, text: STRING>>, metadata MAP<STRING, STRING>"
RESULT = "category STRING, combo STRING, n_qa INT, timestamp STRING, ragas ARRAY<STRUCT<strategy: STRING, faithfulness: DOUBLE, answer_relevancy: DOUBLE, context_precision: DOUBLE, context_recall: DOUBLE>>"
METRICS = (
    "backend STRING, pdf_name STRING, mode STRING, error STRING, timestamp STRING, pages ARRAY<STRUCT<page: INT, speed_s: DOUBLE, word_count: INT, omnidoc: STRUCT<edit_dist: DOUBLE, bleu: DOUBLE, meteor: DOUBLE, teds_html: DOUBLE>>>, "
    "summary STRUCT<avg_edit_dist: DOUBLE, avg_text_ned: DOUBLE, avg_bleu: DOUBLE, avg_meteor: DOUBLE, avg_teds_html: DOUBLE, avg_speed_s: DOUBLE, total_time_s: DOUBLE, total_words: INT>"
)

_PARSERS: dict[str, Callable] = {}


def register_parser(name: str):
    """Register a page parser: a callable(iterator of pandas batches with path and content) giving batches of pages."""

    def add(f):
        _PARSERS[name] = f
        return f

    return add


def parser(name: str) -> Callable:
    if name not in _PARSERS:
        raise KeyError(f"unknown parser {name!r}; available: {', '.join(sorted(_PARSERS)) or 'none'}")
    return _PARSERS[name]


def parsers() -> list[str]:
    return sorted(_PARSERS)


def read_documents(spark: SparkSession, path: str, backend: str, pattern: str = "*.pdf") -> DataFrame:
    """Pages of the files under a folder, by a registered parser; one file is parsed in one task and its bytes stay there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(parser(backend), f"path STRING, {PAGE}, error STRING")


def response_pages(responses: DataFrame, key: str, body: str) -> DataFrame:
    """JSON responses to pages: for each element its page and its markdown, or its text where that is empty; a page's elements are joined."""
    schema = "elements ARRAY<STRUCT<page: INT, content: STRUCT<markdown: STRING, text: STRING>>>"
    e = responses.select(key, F.posexplode(F.from_json(body, schema)["elements"]).alias("pos", "e"))
    content = F.coalesce(F.nullif("e.content.markdown", F.lit("")), F.nullif("e.content.text", F.lit("")))
    parts = e.select(key, F.col("e.page").alias("page_num"), "pos", content.alias("c")).where("c IS NOT NULL")
    listed = parts.groupBy(key, "page_num").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("cs"))
    return listed.select(key, "page_num", F.array_join(F.transform("cs", lambda x: x["c"]), "\n\n").alias("markdown"))


def between_tokens(output: Column, start: str, end: str) -> Column:
    """The payload that a subprocess printed between two marks; empty without them."""
    return F.regexp_extract(output, f"(?s)\\Q{start}\\E(.*?)\\Q{end}\\E", 1)


def raw_blocks(blocks: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Blocks under either of their field names, without those that lack a label, within a range of pages (inclusive)."""
    have = set(blocks.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None))
    df = blocks.withColumn("label", pick("block_label", "label")).withColumn("content", pick("block_content", "content")).where("label IS NOT NULL")
    if first is not None:
        df = df.where(F.col("page_num") >= first)
    return df if last is None else df.where(F.col("page_num") <= last)


def newest(rows: DataFrame, keys: list[str], when: str, tie: str) -> DataFrame:
    """The row with the latest ``when`` of each key; a tie keeps the first by ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.desc(when), tie)
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def read_metrics(spark: SparkSession, *folders: str) -> DataFrame:
    """metrics.json files under the folders: unreadable and failed runs are skipped, the newest of (backend, pdf_name) stays; legacy fields fall back and the sentinel -1 is null."""
    df = spark.read.schema(METRICS).option("recursiveFileLookup", "true").option("pathGlobFilter", "metrics.json").option("multiLine", "true").option("mode", "PERMISSIVE").json(list(folders))
    good = df.withColumn("path", F.input_file_name()).where("backend IS NOT NULL AND coalesce(error, '') = ''")
    s = "summary."
    return newest(good, ["backend", "pdf_name"], "timestamp", "path").select(
        "backend", "pdf_name", "mode", "timestamp", F.coalesce(f"{s}avg_edit_dist", f"{s}avg_text_ned").alias("ned"), F.when(F.col(f"{s}avg_teds_html") >= 0, F.col(f"{s}avg_teds_html")).alias("teds"), F.col(f"{s}avg_speed_s").alias("speed_s"), F.coalesce(f"{s}total_words", F.lit(0)).alias("words"), "path"
    )


def finished(rows: DataFrame, folder: str, pattern: str = "DONE") -> DataFrame:
    """Only rows whose file lies in a folder with a marker file; the folder ``prepared`` is no result."""
    spark = rows.sparkSession
    # file:/ and file:/// are the same place
    parent = lambda c: F.regexp_replace(F.regexp_extract(c, r"^(.*)/[^/]+$", 1), r"^(\w+):/+", "$1:/")
    # the driver lists files anyway; markers are often empty, and a scan passes over empty files
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).inputFiles()
    marks = spark.createDataFrame([(x,) for x in listed], "path STRING").select(parent(F.col("path")).alias("__folder"))
    return rows.withColumn("__folder", parent(F.col("path"))).where(~F.col("__folder").endswith("/prepared")).join(marks, "__folder", "left_semi").drop("__folder")


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """result.json files to one row for each strategy: category, n_qa (the category's largest), strategy and metrics."""
    df = spark.read.schema(RESULT).option("recursiveFileLookup", "true").option("pathGlobFilter", "result.json").option("multiLine", "true").json(folder).where("category IS NOT NULL")
    rows = df.select("category", "n_qa", F.explode("ragas").alias("r")).select("category", "n_qa", "r.*")
    return rows.withColumn("n_qa", F.max("n_qa").over(Window.partitionBy("category")))


def read_latency(spark: SparkSession, folder: str) -> DataFrame:
    """latency.csv files with a byte-order mark in the header; rows that don't fit are skipped."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "latency.csv").option("header", "true").option("mode", "DROPMALFORMED").csv(folder)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns]).withColumn("latency_ms", F.expr("try_cast(latency_ms AS DOUBLE)"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set file: query_id, question, ground_truth."""
    schema = "num_qa INT, qa_pairs ARRAY<STRUCT<query_id: STRING, question: STRING, ground_truth: STRING>>"
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.inline("qa_pairs"))


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    """Write with the commit protocol, so that the marker appears only after all data."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def append_run(df: DataFrame, path: str) -> None:
    """Append a run's rows, by run_id."""
    df.write.mode("append").partitionBy("run_id").parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the greatest run_id; only that partition is read."""
    runs = spark.read.parquet(path)
    last = runs.agg(F.max("run_id")).first()[0]
    return runs.where(F.col("run_id") == last)


def folder_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Megabytes by first folder below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return files.groupBy(F.regexp_extract("path", rf"{folder.rstrip('/')}/([^/]+)/", 1).alias("name")).agg(F.round(F.sum("length") / 1e6, 6).alias("mb"))


def page_texts(worker_output: Column) -> Column:
    """A worker's JSON object of page number to text as a map."""
    return F.transform_keys(F.from_json(worker_output, "MAP<STRING, STRING>"), lambda k, _: k.cast("int"))


def judged_corpus(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (first entry of an id), queries with text, and the judgements whose both ends are there."""
    first = corpus.groupBy("doc_id").agg(F.min_by(F.struct("title", "text"), "corpus_key").alias("s")).select("doc_id", "s.*")
    asked = queries.where(T.strip_ends(F.coalesce("text", F.lit(""))) != "")
    kept = qrels.where("score IS NOT NULL").dropDuplicates(["query_id", "doc_id", "score"]).join(asked, "query_id", "left_semi").join(first, "doc_id", "left_semi")
    return first, asked, kept


