"""Problem 3: percentiles a group over very many values, exact or with a known relative error, from parts that can be merged.

A part is a table of group-value counts. With ``error`` > 0 a value is replaced by its bucket on a geometric grid, so a part has a bounded
number of rows a group however many values it stands for; with ``error`` = 0 the values themselves are counted. Parts of separate partitions
or days are merged by adding counts. The percentile step sorts by ranges of buckets: running sums within a range, plus the totals of the
ranges before it, give cumulative frequencies, and the first value that reaches a target rank is the percentile. No range and no group is
ever sorted as a whole, so a group with a third of all rows is no hot task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.scoring import ranges_by_quantiles
from foliant.session import materialize

#: Percentiles reported, in thousandths.
PERMILLE = (10, 50, 250, 500, 750, 900, 950, 990, 999)
#: Relative error of a reported value.
ERROR = 0.005
#: Buckets in one range.
RANGE = 64


def gamma(error: float) -> float:
    """Ratio of neighbouring bucket limits for a relative error."""
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float) -> Column:
    """Number of the bucket (g^(b-1), g^b] that holds a positive value."""
    return F.ceil(F.log(value) / F.lit(math.log(gamma(error)))).cast("int")


def parts(rows: DataFrame, groups: list[str], value: str, key: str | None = None, error: float = ERROR) -> DataFrame:
    """Counts by group and value (or bucket): the groups, ``bucket``, ``value`` and ``n``.

    Null, NaN, infinite and negative values (the sentinel -1.0 among them) aren't measurements and are left out; zero is a value of its own. Rows that
    share a non-null ``key`` within group and bucket were delivered twice and count once. A null group is a group. ``value`` is null in
    buckets of an error > 0, except that zero keeps its value.
    """
    v = F.col(value)
    good = rows.where(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    grid = F.when(v > 0, bucket(v, error or ERROR)).otherwise(F.lit(-(2**31)))
    named = [F.col(g) for g in groups] + [grid.alias("bucket"), (F.when(v == 0, v) if error else v).alias("value")]
    names = [*groups, "bucket", "value"]
    if key:
        once = good.select(F.col(key).alias("__key"), *named).groupBy("__key", *names).agg(F.count("*").alias("c"))
        good = once.select(*names, F.when(F.col("__key").isNull(), F.col("c")).otherwise(F.lit(1)).alias("n"))
    else:
        good = good.select(*named, F.lit(1).alias("n"))
    return good.groupBy(*names).agg(F.sum("n").cast("long").alias("n"))


def merge(counted: DataFrame, groups: list[str]) -> DataFrame:
    """Parts added up to coarser groups."""
    return counted.groupBy(*groups, "bucket", "value").agg(F.sum("n").cast("long").alias("n"))


def percentiles(counted: DataFrame, groups: list[str], error: float = ERROR, permille: tuple[int, ...] = PERMILLE) -> DataFrame:
    """The groups, ``p``, ``n`` (values in the group), ``value``, ``low``, ``high`` and ``error`` for every target.

    The percentile p is the smallest value that at least p of the n values don't exceed; it lies in [low, high] and differs from ``value`` by at
    most ``error`` times itself. Ties count as often as they occur; an empty table gives no rows.
    """
    g = gamma(error or ERROR)
    # a range of buckets holds a bounded number of rows; of exact values as many as there are, so their ranges follow the quantiles
    ranged = counted.withColumn("range", F.floor(F.col("bucket") / RANGE)) if error else ranges_by_quantiles(counted, groups, "value")
    within = Window.partitionBy(*groups, "range").orderBy("bucket", "value")
    group = Window.partitionBy(*groups)
    totals = ranged.groupBy(*groups, "range").agg(F.sum("n").alias("in_range"))
    offsets = totals.select(
        *groups,
        "range",
        F.coalesce(F.sum("in_range").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("in_range").over(group).alias("total"),
    )
    a, b = ranged.withColumn("up_to", F.sum("n").over(within)).alias("a"), offsets.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in groups] + [F.col("a.range") == F.col("b.range")]
    targets = F.array(*[F.struct(F.lit(t).alias("t"), F.expr(f"(total * {t} + 999) div 1000").alias("rank")) for t in permille])
    reached = (
        a.join(b, same)
        .select(*[F.col(f"a.{c}").alias(c) for c in groups], "bucket", "value", "total", (F.col("offset") + F.col("up_to")).alias("up_to"), "n")
        .select(*groups, "bucket", "value", "total", F.explode(F.filter(targets, lambda t: (t["rank"] <= F.col("up_to")) & (t["rank"] > F.col("up_to") - F.col("n")))).alias("hit"))
    )
    exact = F.col("value").isNotNull()
    return reached.select(
        *groups,
        (F.col("hit.t") / 1000).alias("p"),
        F.col("total").alias("n"),
        F.round(F.coalesce("value", 2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1)), 6).alias("value"),
        F.round(F.coalesce("value", F.pow(F.lit(g), F.col("bucket") - 1)), 6).alias("low"),
        F.round(F.coalesce("value", F.pow(F.lit(g), F.col("bucket"))), 6).alias("high"),
        F.when(exact, F.lit(0.0)).otherwise(F.lit(float(error))).alias("error"),
    )


def latency_percentiles(latency: DataFrame, error: float = ERROR) -> DataFrame:
    """Percentiles of latency_ms for each strategy over single days (``scope`` day) and over all days (``scope`` all, ``day`` null).

    The days' parts are written once and added up for the whole; a row that was delivered twice counts once, on the day it ran, however late
    it was loaded. Time-outs count with the time that was measured.
    """
    rows = latency.select("lat_id", "strategy", F.to_date("run_at").alias("day"), "latency_ms")
    daily = materialize(parts(rows, ["strategy", "day"], "latency_ms", "lat_id", error), "daily-counts")
    both = daily.withColumn("scope", F.lit("day")).unionByName(
        merge(daily, ["strategy"]).select(F.lit("all").alias("scope"), "strategy", F.lit(None).cast("date").alias("day"), "bucket", "value", "n")
    )
    return percentiles(both, ["scope", "strategy", "day"], error)
