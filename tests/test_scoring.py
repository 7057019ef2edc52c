import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import scoring as S


def test_weights():
    assert sum(S.CRITERIA.values()) == pytest.approx(1) and sum(S.COMPOSITE.values()) == pytest.approx(1)
    assert all(sum(p.values()) == pytest.approx(1) for p in S.PROFILES.values())


def test_scores(spark):
    rows = spark.createDataFrame([(0.7, 0.6), (0.66, 0.5), (0.5, 0.2), (0.1, 0.1), (None, None)], "n double, t double").select(S.ned_score(F.col("n")), S.teds_score(F.col("t"))).collect()
    assert [tuple(r) for r in rows] == [(5, 5), (4, 4), (2, 2), (1, 1), (1, 1)]


def test_scorecard(spark):
    scores = [("paddleocr-vl", "a", "text", "native", 0.82, None, 10), ("paddleocr-vl", "b", "table", "72dpi", 0.77, 0.56, 10), ("paddleocr-vl", "b", "table", "150dpi", 0.60, 0.56, 10), ("other", "a", "text", "native", 0.5, None, None)]
    df = spark.createDataFrame(scores, "backend string, pdf string, doc_class string, dpi string, ned double, teds double, words long")
    card = {r.backend: r for r in S.weighted_scorecard(df).collect()}
    assert card["paddleocr-vl"]["rank"] == 1 and card["paddleocr-vl"].dpi_stability == 2 and card["other"].dpi_stability == 5 and card["other"].data_security == 3
    weak = S.weaknesses(S.weighted_scorecard(df)).collect()
    assert weak[0].backend == "other" and weak[0].weakness.startswith("parsing_accuracy -3")


def test_display(spark):
    rows = spark.createDataFrame([("e5_korean_bm25_colbert",), ("custom",)], "s string").select(S.display_name(F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == ["E5-multilingual + BM25 + ColBERT", "custom"]


def test_order_statistics_against_sorting(spark):
    rng = random.Random(3)
    data = {g: [round(rng.expovariate(0.01), 1) for _ in range(n)] for g, n in (("a", 1), ("b", 20), ("c", 301))}
    data["d"] = [88.0] * 50  # all ties
    rows = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("a", -1.0), ("a", float("nan"))], "strategy string, latency_ms double")
    for r in S.latency_summary(rows).collect():
        s = sorted(data[r.strategy])
        assert (r.p50, r.p95, r.queries) == (s[len(s) // 2], s[int(0.95 * len(s))], len(s))


def test_ranking(spark):
    rows = spark.createDataFrame([("c", "a", 1.0, 1.0, 1.0, 1.0), ("c", "b", 0.5, None, 0.5, 0.5), ("c", "b", None, None, None, None)], "category string, strategy string, context_recall double, context_precision double, faithfulness double, answer_relevancy double")
    latency = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "strategy string, latency_ms double")
    got = S.rank_combos(S.strategy_means(rows), latency).orderBy("rank").collect()
    assert [(r.strategy, r.composite, r.gap_pct, r.median_latency) for r in got] == [("a", 1.0, 0.0, 1.5), ("b", 0.35, 65.0, None)]
