"""Scorecards, rankings and latency summaries over benchmark rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import materialize

#: Criteria of the scorecard with their weights, and attributes of backends (security, cost, ease); others have 3.
CRITERIA = {"parsing_accuracy": 0.35, "data_security": 0.20, "cost_efficiency": 0.15, "table_accuracy": 0.15, "dpi_stability": 0.10, "ease_of_adoption": 0.05}
ATTRIBUTES = {"pymupdf": (5, 5, 5), "docling": (5, 5, 2), "openai": (2, 1, 5), "upstage": (2, 2, 5), "paddleocr-vl": (5, 5, 3), "deepseek-ocr2": (5, 5, 3)}
#: Weights of the composite score, and of the scoring profiles.
COMPOSITE = {"context_recall": 0.35, "context_precision": 0.30, "faithfulness": 0.20, "answer_relevancy": 0.15}
PROFILES = {
    "balanced": {"faithfulness": 0.25, "answer_relevancy": 0.25, "context_precision": 0.25, "llm_context_recall": 0.25},
    "precision_critical": {"faithfulness": 0.4, "context_precision": 0.3, "answer_relevancy": 0.3},
    "speed_critical": {"answer_relevancy": 0.5, "faithfulness": 0.5},
    "comprehensive": {"faithfulness": 0.15, "answer_relevancy": 0.15, "context_precision": 0.15, "llm_context_recall": 0.15, "factual_correctness": 0.15, "context_entity_recall": 0.10, "response_relevancy": 0.15},
}
#: Display names of strategy layers, in the order they are looked for.
DISPLAY = (
    (("openai", "OpenAI"), ("upstage", "Upstage"), ("bge-m3", "BGE-M3"), ("kosimcse", "KoSimCSE"), ("e5", "E5-multilingual")),
    (("splade", "SPLADE"), ("bm25", "BM25")),
    (("colbert", "ColBERT"), ("flashrank", "FlashRank")),
)
API_KEYS = ("openai", "upstage")
#: Millions of parameters of local dense models.
PARAMETERS = {"bge-m3": 568.0, "e5": 560.0, "kosimcse": 110.0}


def thresholds(value: Column, limits: tuple[float, float, float, float]) -> Column:
    """5..2 by the first limit reached, else 1 (null too)."""
    out = F.when(value >= limits[0], 5)
    for score, limit in zip((4, 3, 2), limits[1:]):
        out = out.when(value >= limit, score)
    return out.otherwise(1)


def ned_score(ned: Column) -> Column:
    return thresholds(ned, (0.70, 0.65, 0.55, 0.45))


def teds_score(teds: Column) -> Column:
    return thresholds(teds, (0.60, 0.50, 0.35, 0.20))


def score_sums(scores: DataFrame) -> DataFrame:
    """Sums and counts by backend, class and resolution, from which averages and spreads follow: one pass over the pages."""
    return scores.groupBy("backend", "doc_class", "dpi").agg(
        F.sum("ned").alias("ned"), F.count("ned").alias("neds"), F.sum("teds").alias("teds"), F.count("teds").alias("tedss"), F.sum("words").alias("words"), F.count("*").alias("rows"),
    )


def backend_averages(scores: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """A row a backend: overall and per class NED, TEDS, volume. ``scores``: backend, pdf, doc_class, dpi, ned, teds, words; ``sums``: its ``score_sums``."""
    sums = score_sums(scores) if sums is None else sums
    mean = lambda c, n, kind=None: F.round(F.sum(c if kind is None else F.when(F.col("doc_class") == kind, F.col(c))) / F.nullif(F.sum(n if kind is None else F.when(F.col("doc_class") == kind, F.col(n))), F.lit(0)), 4)
    means = sums.groupBy("backend").agg(
        mean("ned", "neds").alias("overall_ned"), mean("ned", "neds", "text").alias("text_ned"), mean("ned", "neds", "table").alias("table_ned"), mean("ned", "neds", "graph").alias("graph_ned"),
        mean("teds", "tedss", "table").alias("table_teds"), mean("teds", "tedss").alias("overall_teds"), F.round(F.coalesce(F.sum("words"), F.lit(0)) / F.sum("rows"), 4).alias("avg_words"), F.sum("words").alias("total_words"),
    )
    pdfs = scores.select("backend", "pdf").groupBy("backend").agg(F.count_distinct("pdf").alias("pdfs"))
    return pdfs.join(means, "backend").where("overall_ned IS NOT NULL")


def dpi_stability(scores: DataFrame, sums: DataFrame | None = None) -> DataFrame:
    """The largest spread of mean NED between resolutions, over tables and graphs, as 1..5; without two resolutions the spread is 0."""
    sums = score_sums(scores) if sums is None else sums
    means = sums.where(F.col("doc_class").isin("table", "graph")).select("backend", "doc_class", F.round(F.col("ned") / F.nullif("neds", F.lit(0)), 6).alias("m"))
    spread = means.groupBy("backend", "doc_class").agg(F.when(F.count("m") >= 2, F.max("m") - F.min("m")).otherwise(F.lit(0.0)).alias("s"))
    all_ = sums.select("backend").distinct().join(spread.groupBy("backend").agg(F.max("s").alias("s")), "backend", "left")
    s = F.round(F.coalesce("s", F.lit(0.0)), 6)
    return all_.select("backend", s.alias("spread"), F.when(s <= 0.03, 5).when(s <= 0.05, 4).when(s <= 0.10, 3).when(s <= 0.20, 2).otherwise(1).alias("dpi_score"))


def weighted_scorecard(scores: DataFrame) -> DataFrame:
    """Six scores a backend, their weighted total and the backend's rank."""
    attribute = lambda i: F.coalesce(F.create_map(*[x for k, v in ATTRIBUTES.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("backend")], F.lit(3))
    sums = materialize(score_sums(scores), "score-sums")  # a row for each backend, class and resolution
    joined = backend_averages(scores, sums).join(dpi_stability(scores, sums), "backend")
    parts = {
        "parsing_accuracy": ned_score(F.col("overall_ned")), "data_security": attribute(0), "cost_efficiency": attribute(1),
        "table_accuracy": teds_score(F.col("table_teds")), "dpi_stability": F.col("dpi_score"), "ease_of_adoption": attribute(2),
    }
    total = sum((F.round(F.col(k) * w, 2) for k, w in CRITERIA.items()), F.lit(0.0))
    scored = joined.select("backend", "overall_ned", *[v.cast("int").alias(k) for k, v in parts.items()]).withColumn("total", F.round(total, 2))
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), F.desc_nulls_last("overall_ned"), "backend")))


def weaknesses(card: DataFrame) -> DataFrame:
    """For every backend but the leader the two criteria that cost it most against the leader."""
    # a scorecard has a row a backend, so the leader's scores are carried over by a window
    order = Window.partitionBy(F.lit(1)).orderBy("rank")
    led = card.select("*", *[F.first(k).over(order).alias(f"top_{k}") for k in CRITERIA])
    gaps = F.array(*[F.struct((-F.round((F.col(f"top_{k}") - F.col(k)) * w, 6)).alias("loss"), F.lit(k).alias("criterion"), (F.col(f"top_{k}") - F.col(k)).alias("points")) for k, w in CRITERIA.items()])
    ranked = led.where("rank > 1").select("backend", F.slice(F.array_sort(F.filter(gaps, lambda g: g["points"] > 0)), 1, 2).alias("g"))
    text = F.array_join(F.transform("g", lambda g: F.concat(g["criterion"], F.lit(" -"), g["points"].cast("string"))), ", ")
    return ranked.select("backend", F.when(F.size("g") > 0, text).otherwise("lower total").alias("weakness"))


def clipped(c: str) -> Column:
    return F.least(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def half_up(score: Column) -> Column:
    """Four places; a sum of four-place metrics by two-place weights is exact in six, so halves don't hang on the order of adding."""
    return F.round(F.round(score, 6) + F.lit(1e-9), 4)


def composite() -> Column:
    return half_up(sum((clipped(k) * w for k, w in COMPOSITE.items()), F.lit(0.0)))


def strategy_means(rows: DataFrame) -> DataFrame:
    """Mean of every metric by category and strategy, nulls left out, with the composite."""
    means = rows.groupBy("category", "strategy").agg(*[F.round(F.avg(k), 4).alias(k) for k in COMPOSITE], F.count("*").alias("n"))
    return means.withColumn("composite", composite())


def rank_combos(means: DataFrame, latency: DataFrame) -> DataFrame:
    """Strategies of each category ranked by composite, with mean and median latency and the gap to the leader in percent."""
    valid = latency.where(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.col("latency_ms") >= 0))
    middle = order_statistics(valid.where("strategy IS NOT NULL"), "strategy", "latency_ms", {"lower": F.expr("(n - 1) div 2"), "upper": F.expr("n div 2")})
    median = middle.select("strategy", F.round((F.col("lower") + F.col("upper")) / 2, 4).alias("median_latency"))
    times = valid.groupBy("strategy").agg(F.round(F.avg("latency_ms"), 4).alias("avg_latency")).join(median, "strategy")
    category = Window.partitionBy("category")
    best = F.max("composite").over(category)
    return means.join(times, "strategy", "left").select(
        "category", "strategy", "composite", "avg_latency", "median_latency", F.row_number().over(category.orderBy(F.desc("composite"), "strategy")).alias("rank"),
        F.when(best > 0, F.round((best - F.col("composite")) / best * 100, 4)).otherwise(F.lit(0.0)).alias("gap_pct"),
    )


def display_name(strategy: Column) -> Column:
    """First name found in each layer, joined; the strategy itself if none is."""
    layers = []
    for names in DISPLAY:
        found = None
        for key, shown in names:
            test = F.contains(F.lower(strategy), F.lit(key))
            found = F.when(test, shown) if found is None else found.when(test, shown)
        layers.append(found)
    name = F.concat_ws(" + ", *layers)
    return F.when(name == "", strategy).otherwise(name)


def is_api(strategy: Column) -> Column:
    return F.contains(F.lower(strategy), F.lit(API_KEYS[0])) | F.contains(F.lower(strategy), F.lit(API_KEYS[1]))


def ranges_by_quantiles(counted: DataFrame, groups: list[str], value: str, ranges: int = 32) -> DataFrame:
    """``counted`` with ``range``: which of ``ranges`` about equally large ranges of its group's values a value lies in.

    The limits are approximate quantiles, so a group whose values lie close together is divided as evenly as any other. A null group is a group.
    """
    at = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    limits = counted.groupBy(*groups).agg(F.percentile_approx(value, at, 1000).alias("limits"))
    same = [F.col(f"x.{g}").eqNullSafe(F.col(f"y.{g}")) for g in groups]
    joined = counted.alias("x").join(limits.alias("y"), same).select("x.*", "y.limits")
    return joined.withColumn("range", F.size(F.filter("limits", lambda x: x < F.col(value)))).drop("limits")


def order_statistics(rows: DataFrame, group: str, value: str, at: dict[str, Column]) -> DataFrame:
    """Values at given 0-based places of each group's sorted values, without sorting any group as a whole.

    Counts of equal values are summed within ranges of values, ranges within the group; ``at`` gives places from the column ``n``.
    """
    counts = ranges_by_quantiles(rows.groupBy(group, value).agg(F.count("*").alias("c")), [group], value)
    sizes = counts.groupBy(group, "range").agg(F.sum("c").alias("s"))
    w = Window.partitionBy(group)
    offsets = sizes.select(group, "range", F.coalesce(F.sum("s").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(w).alias("n"))
    placed = counts.join(offsets, [group, "range"]).withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(group, "range").orderBy(value)))
    hit = lambda place: F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col(value)))
    return placed.groupBy(group).agg(F.max("n").alias("n"), *[hit(p).alias(name) for name, p in at.items()])


def latency_summary(latency: DataFrame) -> DataFrame:
    """Queries, mean, extremes and the 50th and 95th percentile (the value at place int(q*n)) by strategy, over measured values."""
    valid = latency.where(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.col("latency_ms") >= 0)).select("strategy", "latency_ms")
    places = order_statistics(valid, "strategy", "latency_ms", {"p50": F.expr("n div 2"), "p95": F.expr("n * 95 div 100")})
    sums = valid.groupBy("strategy").agg(F.round(F.avg("latency_ms"), 1).alias("avg_ms"), F.min("latency_ms").alias("min_ms"), F.max("latency_ms").alias("max_ms"))
    return places.join(sums, "strategy").select("strategy", F.col("n").alias("queries"), "avg_ms", "min_ms", "max_ms", "p50", "p95")


def parameter_efficiency(means: DataFrame) -> DataFrame:
    """Mean composite of each local dense model per million parameters, times 1000, and its ratio to the best."""
    size = F.create_map(*[F.lit(x) for pair in PARAMETERS.items() for x in pair])
    dense = means.withColumn("model", F.element_at(F.split("strategy", r"\+"), 1)).groupBy("model").agg(F.round(F.avg("composite"), 6).alias("composite")).withColumn("params_m", size[F.col("model")]).where("params_m IS NOT NULL")
    scored = dense.withColumn("efficiency", F.round(F.col("composite") / F.col("params_m") * 1000, 6))
    return scored.withColumn("of_best", F.round(F.col("efficiency") / F.max("efficiency").over(Window.partitionBy()), 6))


def projected_sizes(current: int) -> list[int]:
    """Numbers of questions a projection is given for."""
    return sorted({5, 10, 20, 50, 100, 200, current})


assert math.isclose(sum(CRITERIA.values()), 1) and math.isclose(sum(COMPOSITE.values()), 1)
