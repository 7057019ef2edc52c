import random
from datetime import date, datetime

import pytest

from foliant.llm import percentiles as P


@pytest.mark.parametrize("error", [0.0, 0.01])
def test_against_sorting(spark, error):
    rng = random.Random(4)
    data = {"a": [rng.lognormvariate(4, 2) for _ in range(500)], "b": [7.0] * 30, "c": [0.0, 0.0, 5.0], None: [1.0, 2.0]}
    rows = [(g, v) for g, vs in data.items() for v in vs] + [("a", None), ("a", float("nan")), ("a", -1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    # parts of two halves, computed apart and then added up
    halves = [P.parts(df.where("hash(v) % 2 = 0"), ["g"], "v", error=error), P.parts(df.where("hash(v) % 2 <> 0 OR v IS NULL"), ["g"], "v", error=error)]
    got = P.percentiles(P.merge(halves[0].unionByName(halves[1]), ["g"]), ["g"], error)
    seen = 0
    for r in got.collect():
        s = sorted(data[r.g])
        exact = s[-(-int(round(r.p * 1000)) * len(s) // 1000) - 1]
        assert r.n == len(s) and r.low - 1e-5 <= exact <= r.high + 1e-5
        assert abs(r.value - exact) <= error * exact + 1e-5
        seen += 1
    assert seen == len(data) * len(P.PERMILLE)


def test_latency(spark):
    at = datetime(2025, 1, 6, 5)
    rows = [(1, "s", 10.0, at), (1, "s", 10.0, at), (2, "s", 30.0, datetime(2025, 1, 7)), (None, "s", 20.0, at), (None, "s", 20.0, at), (3, "s", -1.0, at), (4, None, 5.0, at)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "lat_id long, strategy string, latency_ms double, run_at timestamp, bucket string")
    got = {(r.scope, r.strategy, r.day, r.p): (r.n, r.value) for r in P.latency_percentiles(df, 0.0).collect()}
    assert got["all", "s", None, 0.5] == (4, 20.0) and got["day", "s", date(2025, 1, 6), 0.5] == (3, 20.0) and got["day", None, date(2025, 1, 6), 0.5] == (1, 5.0)
    assert P.latency_percentiles(df.limit(0)).count() == 0
