import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "rule, before, after",
    [
        (T.strip_fences, "```markdown\n# Title\ntext\n```", "# Title\ntext\n"),
        (T.unify_bullets, "* item", "- item"), (T.unify_bullets, "+ item", "- item"), (T.unify_bullets, "• item", "- item"), (T.unify_bullets, "  * nested", "  - nested"), (T.unify_bullets, "- item", "- item"),
        (T.plain_headers, "# **Title**", "# Title"), (T.plain_headers, "### **Sub**", "### Sub"), (T.strip_quotes, "> quoted text", "quoted text"),
        (T.strip_locations, "hello<|LOC_35|><|LOC_39|> world", "hello world"), (T.strip_locations, "a<|SEP|>b", "ab"), (T.collapse_blanks, "a\n\n\n\n\nb", "a\n\n\nb"),
        (T.respace_tables, "|a|  b |", "| a | b |"), (T.strip_html, "<p>a &amp; <b>b</b></p>", "a & b"), (T.html_to_markdown, "<h2>T</h2><ul><li>x</li></ul>", "## T\n\n- x"),
    ],
)
def test_rules(spark, rule, before, after):
    assert one(spark, before, rule) == after


def test_normalize_counts_and_nulls(spark):
    columns = T.normalize_markdown(F.col("c"))
    rows = spark.createDataFrame([("```md\n* a\n```\n> q\n",), ("",), (None,)], "c string").select(*[v.alias(k) for k, v in columns.items()]).collect()
    assert (rows[0]["text"], rows[0]["fences"], rows[0]["bullets"], rows[0]["quotes"]) == ("- a\n\nq", 1, 1, 1)
    assert rows[1]["text"] == "" and sum(rows[1][k] for k in columns if k != "text") == 0
    assert rows[2]["text"] is None


def test_edit_similarity(spark):
    pairs = [("a b", "a  b", 1.0), ("", "", 1.0), ("abc", "", 0.0), ("cat", "hat", 2 / 3)]
    rows = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(T.edit_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in rows] == pytest.approx([p[2] for p in pairs])


def test_structure(spark):
    flags = T.structure(F.col("c"))
    row = spark.createDataFrame([("# T\n\n| a |\n$x$ ```",)], "c string").select(*[v.alias(k) for k, v in flags.items()]).first()
    assert row.has_headers and row.has_tables and row.has_formulas and row.has_code and row.line_count == 4
