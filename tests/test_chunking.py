from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.operators import chunking


def chunks(spark, text, size=512, overlap=64, sep="\n\n"):
    df = spark.createDataFrame([(text, size, overlap, sep)], "t string, s int, o int, p string")
    return df.select(chunking.packed_paragraphs(F.col("t"), F.col("s"), F.col("o"), F.col("p")).alias("c")).first()[0]


def test_packing(spark):
    assert chunks(spark, "  \n ") is None and chunks(spark, None) is None
    assert chunks(spark, "one") == ["one"]
    assert len(chunks(spark, "\n\n".join(["x" * 300] * 3), 400)) >= 2
    a, b = chunks(spark, "\n\n".join(["a" * 300, "b" * 300]), 400, 10)
    assert a == "a" * 300 and b == "a" * 10 + "\n\n" + "b" * 300
    assert chunks(spark, "y" * 900, 100) == ["y" * 900]  # a paragraph is never cut


def test_ids(spark):
    row = spark.createDataFrame([("a.pdf",)], "p string").select(chunking.document_id(F.col("p")).alias("d"), chunking.text_id(F.col("p"), "doc").alias("t")).first()
    assert len(row.d) == 12 and row.t.startswith("doc_") and len(row.t) == 16


def test_boxes(spark):
    box = "array<struct<x0 double, y0 double, x1 double, y1 double, text string>>"
    rows = [(1, "p1_c0", "alpha beta", [(0.0, 1.0, 2.0, 3.0, " Alpha"), (5.0, 0.0, 6.0, 2.0, "beta"), (9.0, 9.0, 9.0, 9.0, "x")]), (2, "p1_c0", "none", None)]
    got = chunking.chunk_boxes(spark.createDataFrame(rows, f"page_id int, chunk_id string, chunk_text string, bbox_data {box}")).orderBy("page_id").collect()
    assert tuple(got[0])[2:] == (0.0, 0.0, 6.0, 3.0) and tuple(got[1])[2:] == (None,) * 4


@settings(deadline=None, max_examples=60)
@given(st.text(alphabet="ab \n", max_size=900))
def test_recursive_split(text):
    parts = chunking.recursive_split(text, 50, 10)
    assert all(0 < len(p) <= 50 for p in parts)
    assert sum(p.count("a") for p in parts) >= text.count("a")


def test_enrich(spark):
    c = spark.createDataFrame([("p", 0, "x"), ("p", 1, "y"), ("q", 0, "z")], "parent_id string, idx int, chunk_text string")
    parents = spark.createDataFrame([("p", "x y", "P")], "parent_id string, parent_text string, title string")
    cache = c.where("chunk_text = 'x'").select(chunking.cache_key(F.col("chunk_text")).alias("hash"), F.lit("about").alias("prefix"))
    got = {r.chunk_text: (r.status, r.enriched_text) for r in chunking.enrich(c, parents, cache).collect()}
    assert got == {"x": ("cached", "about\n\nx"), "y": ("missing", "y"), "z": ("orphan", "z")}
