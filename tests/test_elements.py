import pytest
from pyspark.sql import functions as F

from foliant.functions import html as H
from foliant.operators import chunking, elements, layout, retrieval, specs, strategies
from foliant.session import drop_intermediates, materialize, scan_tasks

TABLES = {
    "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>": "| a | b |\n| --- | --- |\n| 1 |  |",
    '<table>\n<tr class="x"><td colspan="2"> <b>wide</b>\ncell </td></tr><tr><td>1</td><td>2</td></tr></table>': "| wide\ncell |  |\n| --- | --- |\n| 1 | 2 |",
    "<table>no rows</table>": "no rows",
    "<table><tr></tr></table>": "|  |\n|  |",
    "": "",
}


def test_tables(spark):
    df = spark.createDataFrame([*TABLES.items(), (None, None)], "h string, want string")
    for r in df.select("want", H.table_markdown(F.col("h")).alias("got")).collect():
        assert r.got == r.want
    whole = '<h2 id="x">Head</h2><p>one</p><table><tr><td>1</td></tr></table><li>item</li><figure><img></figure>&amp;<table><tr><td>2</td></tr></table>'
    got = spark.range(1).select(H.simple_markdown(F.lit(whole))).first()[0]
    assert got == "## Headone\n| 1 |\n| --- |- item\n![image](/image/placeholder)\n&amp;| 2 |\n| --- |"
    long_ = "<table>" + "<tr><td>1</td><td>2</td></tr>" * 3000 + "</table>"
    assert spark.range(1).select(H.table_markdown(F.lit(long_))).first()[0].count("\n") == 3000


def test_contents(spark):
    rows = [(1, "table", "<TABLE><tr><td>1</td></tr></TABLE>"), (2, "table", "a < b"), (3, "image", "x"), (4, "chart", "x"), (5, "chart", "<table><tr><td>1</td></tr></table>"), (6, "formula", "x^2"), (7, "formula", "  "),
            (8, "doc_title", "T"), (9, "paragraph_title", "T"), (10, "number", "7"), (11, "new", "it's"), (12, None, "x"), (13, "text", None), (14, "text", "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "block_key long, block_label string, block_content string, bbox int")
    got = {r.block_key: (r.html, r.markdown, r.text) for r in elements.contents(df).collect()}
    assert got[2] == ("<table><tr><td>a &lt; b</td></tr></table>", "| a &lt; b |\n| --- |", "a < b") and got[1][0].startswith("<TABLE>")
    assert got[3] == got[4] == (elements.FIGURE, "![image](/image/placeholder)", "") and got[5][1] == "| 1 |\n| --- |"
    assert got[6] == ('<p class="equation">x^2</p>', "$$x^2$$", "x^2") and got[7][1] == ""
    assert got[8][:2] == ("<h1>T</h1>", "# T") and got[9][:2] == ("<h2>T</h2>", "## T") and got[10][0] == "<span>7</span>" and got[11] == ("<p>it&#x27;s</p>", "it's", "it's")
    assert 12 not in got and 13 not in got and got[14] == ("<p></p>", "", "") and elements.contents(df.limit(0)).count() == 0


def test_corners_and_pages(spark):
    df = spark.createDataFrame([([10.0, 20.0, 30.0, 40.0], 1), ([1.0], 2), (None, 3)], "b array<double>, page_num int")
    at = lambda w, h: [r[0] and [tuple(p) for p in r[0]] for r in df.select(elements.corners(F.col("b"), F.lit(w), F.lit(h))).collect()]
    assert at(100.0, 200.0) == [[(0.1, 0.1), (0.3, 0.1), (0.3, 0.2), (0.1, 0.2)], None, None] and at(0.0, 200.0)[0] == [(0.0, 0.1), (0.0, 0.1), (0.0, 0.2), (0.0, 0.2)]
    assert [r.page_num for r in elements.shifted(df, 5).collect()] == [6, 7, 8]


@pytest.mark.parametrize(
    "name, kind, resolution",
    [("text_only.pdf", "text", "native"), ("table_native.pdf", "table", "native"), ("table_image.pdf", "table", "image"), ("table_image_200dpi.pdf", "table", "200dpi"), ("graph_rich_image_72dpi.pdf", "graph", "72dpi"), ("graph_rich_image_150dpi.pdf", "graph", "150dpi"), ("other.pdf", "unknown", "native"), (None, "unknown", "native")],
)
def test_classes(spark, name, kind, resolution):
    c = F.lit(name).cast("string")
    assert tuple(spark.range(1).select(specs.document_class(c), specs.resolution_class(c)).first()) == (kind, resolution)


def test_presets(spark):
    assert {p: specs.combinations(spark, p).count() for p in specs.RETRIEVAL} == {"quick": 1, "standard": 10, "full": 20, "service": 6}
    one = specs.combinations(spark, "quick").first()
    assert (one.label, one.retrieval_mode, one.index_key) == ("bge-m3+korean_bm25+flashrank+contextual", "hybrid_with_flashrank_rerank_and_llm_support", "bge-m3:korean_bm25")
    for wrong in ("nothing", (("gpt",), ("splade",), ("colbert",), ("contextual",)), (("e5",), ("tfidf",), ("colbert",), ("contextual",)), (("e5",), ("splade",), (None,), ("contextual",)), (("",), ("splade",), ("colbert",), ("contextual",))):
        with pytest.raises(ValueError):
            specs.combinations(spark, wrong)
    rows = specs.parsing_specs(spark, "phase1").collect()
    assert len(rows) == 22 and {r.gt_name for r in rows if r.pdf_name.startswith("table")} == {"table_native.md"}
    assert specs.parsing_specs(spark, "quick").first().label == "pymupdf-text-only-direct" and specs.parsing_specs(spark, "phase2").count() == 88
    with pytest.raises(ValueError):
        specs.parsing_specs(spark, "nothing")


def test_stored_index(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "red apple pie"), (2, "green apple"), (3, None), (4, "")], "corpus_key long, content string")
    queries = spark.createDataFrame([("q", "red apple")], "query_id string, text string")
    want = sorted(map(tuple, retrieval.bm25_search(corpus, queries).collect()))
    cache = retrieval.IndexCache(spark, str(tmp_path))
    assert not cache.has(cache.path("e5", "bm25"))
    assert sorted(map(tuple, cache.get_or_build("e5", "bm25", corpus).search(queries).collect())) == want
    other = corpus.where("corpus_key = 2")
    # the same pair has the same index, whatever chunks come with it; rebuilt only if asked for
    assert cache.get_or_build("e5", "bm25", other).texts == 4 and cache.get_or_build("e5", "bm25", other, contextual=True).texts == 1
    assert cache.get_or_build("e5", "bm25", other, rebuild=True).texts == 1
    chars = retrieval.bm25_index(corpus, lambda c: F.filter(F.split(c, ""), lambda x: x > " "))
    assert chars.terms.where("term = 'r'").first().df == 2


class _Broken:
    name = "broken"

    def index(self, chunks):
        pass

    def retrieve(self, queries, k=5):
        return queries.select("no_such_column")


class _Partly:
    name = "partly"

    def index(self, chunks):
        pass

    def retrieve(self, queries, k=5):
        fine = F.col("query_id") == "a"
        return queries.select("query_id", F.when(fine, 1).alias("rank"), F.when(fine, F.lit(7)).cast("long").alias("chunk_key"), F.when(fine, 0.5).alias("score"), F.when(~fine, "time-out").alias("error"))


def test_errors_are_kept(spark):
    queries = spark.createDataFrame([("a", "x"), ("b", "y")], "query_id string, text string")
    got = {(r.strategy, r.query_id): r for r in strategies.run([_Broken(), _Partly()], queries).collect()}
    assert "no_such_column" in got["broken", "a"].error and got["broken", "b"].num_results == 0
    assert got["partly", "a"].num_results == 1 and got["partly", "a"].error is None and got["partly", "b"].num_results == 0 and got["partly", "b"].error == "time-out"


def test_prefixes_are_added_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    of = lambda *rows: spark.createDataFrame(rows, "cache_key string, prefix string")
    assert chunking.append_prefixes(of(("a", "x"), ("a", "x"), (None, "y")), cache) == 1
    assert chunking.append_prefixes(of(("a", "z"), ("b", "w")), cache) == 1
    assert {tuple(r) for r in spark.read.parquet(cache).collect()} == {("a", "x"), ("b", "w")}


def test_intermediates(spark, tmp_path):
    df = materialize(spark.range(10).toDF("id"), "some")
    path = df.inputFiles()[0]
    assert df.count() == 10 and scan_tasks(df) >= 1
    assert drop_intermediates(spark) >= 1 and not __import__("os").path.exists(path.removeprefix("file://")) and drop_intermediates(spark) == 0


def test_overlaps_against_all_pairs(spark):
    import random

    rng = random.Random(6)
    rows = [(g, i, *(lambda x, y: (x, y, x + rng.choice((0.0, 5.0, 90.0, 400.0)), y + rng.choice((5.0, 120.0))))(rng.uniform(-50, 900), rng.uniform(0, 900))) for g in ("a", "b") for i in range(40)]
    rows += [("a", 98, 0.0, 0.0, 100.0, 100.0), ("a", 99, 100.0, 0.0, 200.0, 100.0), ("a", 97, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.g, r.k, r.other) for r in layout.overlapping(df, ["g"], "k").collect())
    box = {(r[0], r[1]): r[2:] for r in rows if r[2] is not None}
    want = sorted((g, i, j) for (g, i), a in box.items() for (h, j), b in box.items() if g == h and i < j and min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1]) and a[2] > a[0] and b[2] > b[0])
    assert got == want and layout.overlapping(df.limit(0), ["g"], "k").count() == 0
