import math
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import session
from foliant.operators import retrieval, strategies

DOCS = [(1, "red apple pie"), (2, "green apple"), (3, "blue sky and red sky"), (4, None), (5, "")]


def brute_bm25(docs, query, mode):
    toks = {k: (t or "").lower().split() for k, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(w for t in toks.values() for w in set(t))
    weigh = lambda t: {w: math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w, c in Counter(t).items() if w in df}
    q = query.split()
    wq = weigh(q) if mode == "reference" else {w: float(c) for w, c in Counter(q).items()}
    return {k: round(sum(wq[w] * v for w, v in weigh(t).items() if w in wq), 6) for k, t in toks.items() if set(t) & set(wq)}


@pytest.mark.parametrize("mode", ["reference", "standard"])
def test_bm25(spark, mode):
    corpus = spark.createDataFrame(DOCS, "corpus_key long, content string")
    queries = spark.createDataFrame([("q", "red red apple"), ("none", "zebra"), ("null", None)], "query_id string, text string")
    got = retrieval.bm25_search(corpus, queries, 10, mode).collect()
    assert {r.corpus_key: r.score for r in got} == pytest.approx(brute_bm25(DOCS, "red red apple", mode), abs=2e-6)
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3] and {r.query_id for r in got} == {"q"}


def test_bm25_empty(spark):
    corpus = spark.createDataFrame([], "corpus_key long, content string")
    queries = spark.createDataFrame([("q", "a")], "query_id string, text string")
    assert retrieval.bm25_search(corpus, queries).count() == 0


def test_dense_against_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(98, None), (99, [0.0] * 8)], "vec_id long, embedding array<float>")
    found = retrieval.dense_search(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), vectors, 5, 2, 16).collect()
    m = m.astype(np.float32).astype(float)
    for q in (0, 20, 40):
        cos = m @ m[q] / np.linalg.norm(m, axis=1) / np.linalg.norm(m[q])
        cos[q] = -2
        want = sorted(range(60), key=lambda i: (-round(cos[i], 6), i))[:5]
        assert [r.vec_id for r in sorted((r for r in found if r.qid == q), key=lambda r: r["rank"])] == want


def test_fusion_and_maxsim(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "qid string, item int, rank int")
    b = spark.createDataFrame([("q", 2, 1)], "qid string, item int, rank int")
    got = retrieval.reciprocal_rank_fusion([a, b], "qid", "item", 5).orderBy("rank").collect()
    assert [(r.item, r.score) for r in got] == [(2, round(1 / 62 + 1 / 61, 8)), (1, round(1 / 61, 8))]
    row = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[2.0, 0.0], [1.0, 3.0]])], "q array<array<double>>, d array<array<double>>").select(retrieval.max_sim(F.col("q"), F.col("d")).alias("s")).first()
    assert row.s == 5.0


def test_strategies(spark):
    chunks = spark.createDataFrame([(k, t) for k, t in DOCS], "chunk_key long, content string")
    queries = spark.createDataFrame([("q", "red sky"), ("n", "zebra")], "query_id string, text string")
    sparse = strategies.SparseStrategy()
    with pytest.raises(ValueError):
        sparse.retrieve(queries)
    both = strategies.Reranked(sparse, chunks)
    both.index(chunks)
    rows = {(r.strategy, r.query_id): r for r in strategies.run([sparse, both], queries, 2).collect()}
    assert rows["bm25+rerank", "q"].results[0].chunk_key == 3 and rows["bm25", "n"].num_results == 0 and len(rows) == 4
    assert strategies.metrics("core") == list(strategies.CORE) and len(strategies.metrics("full")) == 15
    assert not set(strategies.metrics("full", has_reference=False)) & {"bleu_score", "context_recall"}
    with pytest.raises(KeyError):
        strategies.metrics("nope")
    filled = strategies.filled_answers(spark.createDataFrame([("a",), ("",), (None,)], "answer string")).collect()
    assert [r.answer for r in filled] == ["a", "No answer was generated.", "No answer was generated."]


def test_bm25_in_blocks(spark):
    # texts and queries in many blocks, equal texts (ties by key), keys that repeat with several lengths, null and empty texts
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(x))] for x in rng.exponential(9, n))
    docs = [(i, text(int(rng.integers(1, 30)))) for i in range(300)]
    docs += [(i + 300, t) for i, t in docs[:60]] + [(7, docs[7][1]), (8, text(5)), (900, None), (901, "")]
    asked = [(f"q{i}", text(int(rng.integers(1, 7)))) for i in range(150)] + [("q1", "w0 w1 w2")]
    corpus = spark.createDataFrame(docs, "corpus_key long, content string")
    queries = spark.createDataFrame(asked, "query_id string, text string")
    average = sum(len((t or "").split()) for _, t in docs) / len(docs)
    entries = Counter((k, len(t.split()), w) for k, t in docs if t for w in t.split())
    df = Counter(w for _, _, w in entries)
    idf = {w: math.log((len(docs) - n + 0.5) / (n + 0.5) + 1) for w, n in df.items()}
    weight = lambda c, n, w: idf[w] * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * n / average))
    held = {}
    for (key, n, w), c in entries.items():
        held.setdefault(w, []).append((key, weight(c, n, w)))
    for mode in ("reference", "standard"):
        want = {}
        for (q, n, w), c in Counter((q, len(t.split()), w) for q, t in asked for w in t.split()).items():
            for key, x in held.get(w, []):
                want.setdefault(q, Counter())[key] += x * (weight(c, n, w) if mode == "reference" else c)
        best = {q: sorted(((-round(s, 6), key) for key, s in found.items()))[:4] for q, found in want.items()}
        got = {}
        index = retrieval.bm25_index(corpus, block_terms=200)
        assert index.blocks.count() > 5
        for r in index.search(queries, 4, mode).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((-r.score, r.corpus_key))
        assert got.keys() == best.keys()
        assert all([k for _, k in got[q]] == [k for _, k in best[q]] and [s for s, _ in got[q]] == pytest.approx([s for s, _ in best[q]], abs=2e-6) for q in best)


def test_bm25_shuffles_no_pairs(spark):
    corpus = spark.createDataFrame([(i, "alpha beta") for i in range(50)], "corpus_key long, content string")
    queries = spark.createDataFrame([(f"q{i}", "alpha") for i in range(50)], "query_id string, text string")
    plan = retrieval.bm25_search(corpus, queries)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" in plan and "Join Inner" not in plan and "MapInArrow" in plan


def _tables(spark, folder):
    """A small corpus with blank texts, queries and judgements as tables."""
    corpus = [(i, f"d{i}", "t", f"red apple {'pie ' * (i % 3)}sky{i % 4}") for i in range(12)] + [(20, "d20", None, ""), (21, "d21", None, None), (22, "d22", "", "  ")]
    spark.createDataFrame(corpus, "corpus_key long, doc_id string, title string, text string").write.parquet(f"{folder}/corpus.parquet")
    spark.createDataFrame([(1, "q1", "red pie"), (2, "q2", "sky1 sky2 pie pie"), (3, "q3", "zebra"), (4, "q4", None)], "query_key long, query_id string, text string").write.parquet(f"{folder}/queries.parquet")
    spark.createDataFrame([("q1", "d2", 1), ("q1", "d3", 1), ("q2", "d1", 2), ("q2", "d5", 0), ("q3", "d1", 1)], "query_id string, doc_id string, score int").write.parquet(f"{folder}/qrels.parquet")
    return str(folder)


def _same_as_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    from foliant.plans import registry

    con = duckdb.connect()
    for t in ("corpus", "queries", "qrels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = registry.queries()[name](spark, folder)
    want = con.sql(registry.oracle_sql()[name])
    assert found.columns == want.columns and sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want.fetchall()))
    return found._jdf.queryExecution().optimizedPlan().toString()


def test_reranked_topk_counts_blank_texts(spark, tmp_path):
    plan = _same_as_sql(spark, _tables(spark, tmp_path), "reranked_topk")
    assert plan.count("Join Cross") == 1


def test_benchmark_run_shares_an_index(spark, tmp_path, monkeypatch):
    built, of = [], retrieval.bm25_index
    monkeypatch.setattr(retrieval, "bm25_index", lambda *a, **k: built.append(1) or of(*a, **k))
    plan = _same_as_sql(spark, _tables(spark, tmp_path), "benchmark_run")
    assert len(built) == 1 and plan.count("Join Cross") == 2


def test_stored_index_is_written_once(spark, tmp_path, monkeypatch):
    made, of = [], retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, name: made.append(name) or of(df, name))
    plan = _same_as_sql(spark, _tables(spark, tmp_path), "stored_bm25_topk")
    assert made == ["asked"] and plan.count("Join Cross") == 1


@pytest.mark.parametrize("name", ["bm25_topk_standard", "recall_at_k", "ndcg_at_k"])
def test_judged_queries_shuffle_no_pairs(spark, tmp_path, name):
    plan = _same_as_sql(spark, _tables(spark, tmp_path), name)
    assert plan.count("Join Cross") == 1


def test_stored_index_leaves_no_disk(spark, tmp_path):
    session.drop_intermediates(spark)
    shared = Path(session.shared_folder(spark).removeprefix("file://"))
    _same_as_sql(spark, _tables(spark, tmp_path), "stored_bm25_topk")
    assert list(shared.glob("indexes-*"))
    session.drop_intermediates(spark)
    assert not list(shared.glob("indexes-*"))


def test_shuffle_files_go_once_a_table_is_stored(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    before = held()
    table = session.materialize(spark.range(100).repartition(3, "id"), "rows")
    until = time.time() + 20
    while (left := held() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and table.count() == 100
