import random
from collections import Counter
from itertools import product

from foliant.llm import packing as P


def test_window_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 12), 4), reverse=True)
        counts = [rng.randint(0, 3) for _ in sizes]
        room = rng.randint(1, 30)
        best = max(t for c in product(*[range(n + 1) for n in counts]) if (t := sum(a * b for a, b in zip(c, sizes))) <= room)
        got = P.best_window(sizes, counts, room)
        assert sum(s * m for s, m in got.items()) == best and all(m <= counts[sizes.index(s)] for s, m in got.items())


def test_plan_uses_every_item_once():
    rng = random.Random(2)
    histogram = {rng.randint(1, 64): rng.randint(1, 400) for _ in range(20)}
    used = Counter()
    plan = P.plan_windows(histogram, 64)
    for pattern, times in plan:
        assert sum(s * m for s, m in pattern.items()) <= 64
        for s, m in pattern.items():
            used[s] += m * times
    assert dict(used) == histogram and len(plan) <= 3 * len(histogram)


def test_containers(spark):
    words = [None, "", "a"] + ["word " * n for n in (1, 3, 3, 3, 50, 7, 9, 30)] + ["same text"] * 40
    docs = spark.createDataFrame([(i, w, "x") for i, w in enumerate(words)], "doc_id long, text string, container string")
    limits = spark.createDataFrame([(1, "byte_bpe_50k", 16), (2, "word_bpe_49k", 40), (3, None, 5), (4, "byte_bpe_50k", None)], "limit_id int, tokenizer string, capacity int")
    rows = P.pack(docs, limits, salts=3).collect()
    for limit, capacity in ((1, 16), (2, 40)):
        mine = [r for r in rows if r.limit_id == limit]
        fill, pieces = Counter(), Counter()
        for r in mine:
            fill[r.container] += r.tokens
            pieces[r.doc_id] += 1
        assert max(fill.values()) <= capacity and {r.doc_id for r in mine} == set(range(len(words)))
        totals = Counter()
        for r in mine:
            totals[r.doc_id] += r.tokens
        assert all((pieces[d] > 1) == (totals[d] > capacity) for d in totals)
        assert {r.container for r in mine} == set(range(max(fill) + 1))
        assert sum(fill.values()) / (capacity * len(fill)) > 0.8
    assert {r.limit_id for r in rows} == {1, 2}
    assert [r.container for r in rows if r.doc_id in (0, 1)] == [0] * 4
    report = {r.limit_id: r for r in P.fill_report(P.pack(docs, limits), limits).collect()}
    assert report[1].documents == len(words) and report[3].containers is None
    assert P.pack(docs.limit(0), limits).count() == 0 and P.pack(docs, limits.limit(0)).count() == 0
