import json

import pytest
from pyspark.sql import functions as F

from foliant.plans import report
from foliant.sources import readers
from foliant.streaming import collector


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_metrics(spark, tmp_path):
    base = {"backend": "x", "pdf_name": "a.pdf", "mode": "direct"}
    put(tmp_path / "1/metrics.json", base | {"timestamp": "2026-01-01 00:00:00", "summary": {"avg_edit_dist": 0.5}})
    put(tmp_path / "2/metrics.json", base | {"timestamp": "2026-03-04 00:00:00", "summary": {"avg_text_ned": 0.9, "avg_teds_html": -1.0}})
    put(tmp_path / "3/metrics.json", base | {"backend": "y", "error": "failed", "timestamp": "2026-03-04 00:00:00"})
    put(tmp_path / "4/metrics.json", "{not json")
    rows = readers.read_metrics(spark, str(tmp_path)).collect()
    assert [(r.backend, r.ned, r.teds) for r in rows] == [("x", 0.9, None)]


def test_results_and_markers(spark, tmp_path):
    for c, n in (("one", 5), ("two", 7)):
        put(tmp_path / f"general/{c}/result.json", {"category": "general", "combo": c, "n_qa": n, "ragas": [{"strategy": c, "faithfulness": 0.5}]})
    put(tmp_path / "general/one/DONE", "")
    rows = readers.read_results(spark, str(tmp_path)).orderBy("strategy").collect()
    assert [(r.strategy, r.n_qa) for r in rows] == [("one", 7), ("two", 7)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "result.json").load(str(tmp_path)).select("path")
    assert [r.path.split("/")[-2] for r in readers.finished(files, str(tmp_path)).collect()] == ["one"]


def test_latency_with_mark(spark, tmp_path):
    put(tmp_path / "a/latency.csv", "﻿strategy,latency_ms\ns,1.5\nt,\n")
    rows = readers.read_latency(spark, str(tmp_path)).orderBy("strategy").collect()
    assert [(r.strategy, r.latency_ms) for r in rows] == [("s", 1.5), ("t", None)]


def test_responses_tokens_questions(spark, tmp_path):
    body = {"elements": [{"page": 1, "content": {"markdown": "", "text": "t"}}, {"page": 1, "content": {"markdown": "m", "text": "x"}}, {"page": 2, "content": {"markdown": "", "text": ""}}]}
    df = spark.createDataFrame([("k", json.dumps(body)), ("bad", "{"), ("none", None)], "k string, body string")
    assert [tuple(r) for r in readers.response_pages(df, "k", "body").collect()] == [("k", 1, "t\n\nm")]
    assert spark.createDataFrame([("noise<<A>>x\ny<<B>>",)], "c string").select(readers.between_tokens(F.col("c"), "<<A>>", "<<B>>")).first()[0] == "x\ny"
    put(tmp_path / "qa.json", {"num_qa": 1, "qa_pairs": [{"query_id": "q", "question": "?", "ground_truth": "!"}]})
    assert readers.read_questions(spark, str(tmp_path / "qa.json")).first().question == "?"


def test_parser_registry(spark, tmp_path):
    with pytest.raises(KeyError, match="available"):
        readers.parser("absent")

    @readers.register_parser("lines")
    def lines(batches):
        import pandas as pd

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                text = content.decode().split("\f")
                yield pd.DataFrame({"path": path, "page_num": range(1, len(text) + 1), "markdown": text, "backend": "lines", "bbox_data": None, "metadata": None, "error": None})

    put(tmp_path / "a.pdf", "one\ftwo")
    rows = readers.read_documents(spark, str(tmp_path), "lines").orderBy("page_num").collect()
    assert [(r.page_num, r.markdown) for r in rows] == [(1, "one"), (2, "two")] and "lines" in readers.parsers()


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "name string, score double")
    text = report.write_report(str(tmp_path / "r.md"), "Title", {"Scores": df}).read_text()
    assert "| a | 0.5000 |" in text and "| b | – |" in text
    with pytest.raises(ValueError):
        report.render("x", {})


def test_stream_drops_repeats(spark, tmp_path):
    row = {"lat_id": 1, "strategy": "s", "latency_ms": 2.0, "run_at": "2025-01-01T00:00:00", "loaded_at": "2025-01-01T00:00:00"}
    put(tmp_path / "in/1.json", "\n".join(json.dumps(row | {"lat_id": i}) for i in (1, 2, 2)))
    rows = collector.once_each(collector.result_stream(spark, str(tmp_path / "in"), 1))
    collector.collect(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    put(tmp_path / "in/2.json", "\n".join(json.dumps(row | {"lat_id": i}) for i in (2, 3)))
    collector.collect(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.lat_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_stored_rows(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "run_id int, strategy string")
    readers.append_run(runs.where("run_id = 1"), str(tmp_path / "runs"))
    readers.append_run(runs.where("run_id = 2"), str(tmp_path / "runs"))
    assert [r.strategy for r in readers.latest_run(spark, str(tmp_path / "runs")).collect()] == ["b"]
    readers.write_table(runs, str(tmp_path / "sets/one"), "strategy")
    assert (tmp_path / "sets/one/_SUCCESS").exists() and spark.read.parquet(str(tmp_path / "sets/one")).count() == 2
    put(tmp_path / "size/x/f", "1234567890" * 100)
    assert [(r.name, r.mb) for r in readers.folder_sizes(spark, str(tmp_path / "size")).collect()] == [("x", 0.001)]


def test_worker_output_and_sets(spark):
    df = spark.createDataFrame([('{"2": "two", "1": null}',), ("{not json",), (None,)], "o string")
    assert [r[0] for r in df.select(readers.page_texts(F.col("o"))).collect()] == [{2: "two", 1: None}, None, None]
    corpus = spark.createDataFrame([(2, "d", "t", "later"), (1, "d", "t", "first"), (3, "e", None, "x")], "corpus_key long, doc_id string, title string, text string")
    queries = spark.createDataFrame([("q", "?"), ("r", " ")], "query_id string, text string")
    qrels = spark.createDataFrame([("q", "d", 1), ("q", "d", 1), ("q", "absent", 1), ("r", "d", 1), ("q", "e", None)], "query_id string, doc_id string, score int")
    first, asked, kept = readers.judged_corpus(corpus, queries, qrels)
    assert {r.text for r in first.collect()} == {"first", "x"} and [r.query_id for r in asked.collect()] == ["q"] and [tuple(r) for r in kept.select("query_id", "doc_id", "score").collect()] == [("q", "d", 1)]
