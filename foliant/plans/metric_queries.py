"""Similarity metrics between parses of one page, and between answers, questions and their sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import similarity
from foliant.functions import text as T
from foliant.operators import layout
from foliant.plans.base import query, strip
from foliant.plans.text_queries import NORMAL
from foliant.sources.tables import table

# the first parse of a page is the truth for its later parses
_PAIRS = "pr AS (SELECT page_id, pdf_path, page_num, coalesce(markdown, '') AS pred, first_value(coalesce(markdown, '')) OVER w AS gt, row_number() OVER w AS rn FROM pages WINDOW w AS (PARTITION BY pdf_path, page_num ORDER BY parsed_at, page_id))"


def _ascii(x):
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', '?', 'g')"


def _ned(a, b):
    a, b = (f"{strip(f'''regexp_replace({_ascii(x)}, '[\\s\\x0B]+', ' ', 'g')''')}" for x in (a, b))
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE round(greatest(0.0, 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))), 6) END"


def _reparsed(spark, folder):
    order = Window.partitionBy("pdf_path", "page_num").orderBy("parsed_at", "page_id")
    pages = table(spark, folder, "pages", "page_id", "pdf_path", "page_num", "markdown", "parsed_at").withColumn("pred", F.coalesce("markdown", F.lit("")))
    return pages.select("page_id", "pdf_path", "page_num", "pred", F.first("pred").over(order).alias("gt"), F.row_number().over(order).alias("rn")).where("rn > 1").drop("rn")


@query("ned_pairs", f"WITH {_PAIRS} SELECT page_id, pdf_path, page_num, {_ned('pred', 'gt')} AS ned FROM pr WHERE rn > 1")
def ned_pairs(spark, folder):
    ned = F.round(T.edit_similarity(T.ascii_only(F.col("pred")), T.ascii_only(F.col("gt"))), 6)
    return _reparsed(spark, folder).select("page_id", "pdf_path", "page_num", ned.alias("ned"))


@query(
    "ned_normalized_vs_raw",
    NORMAL
    + f", {_PAIRS}, z AS (SELECT pr.page_id, pred, gt, a.text AS npred, coalesce(b.text, '') AS ngt FROM pr JOIN n a USING (page_id) JOIN (SELECT pdf_path, page_num, arg_min(page_id, (parsed_at, page_id)) AS fid FROM pages GROUP BY ALL) f USING (pdf_path, page_num) JOIN n b ON b.page_id = f.fid WHERE rn > 1), s AS (SELECT page_id, {_ned('pred', 'gt')} AS raw, {_ned('''coalesce(npred, '')''', 'ngt')} AS normalized FROM z) SELECT page_id, raw, normalized, round(normalized - raw, 6) AS delta FROM s",
)
def ned_normalized_vs_raw(spark, folder):
    ned = lambda a, b: F.round(T.edit_similarity(T.ascii_only(a), T.ascii_only(b)), 6)
    norm = lambda c: F.coalesce(T.normalize_markdown(F.col(c))["text"], F.lit(""))
    pairs = _reparsed(spark, folder).select("page_id", ned(F.col("pred"), F.col("gt")).alias("raw"), ned(norm("pred"), norm("gt")).alias("normalized"))
    return pairs.withColumn("delta", F.round(F.col("normalized") - F.col("raw"), 6))


@query("page_similarity")
def page_similarity(spark, folder):
    """BLEU, METEOR and ROUGE-L between parses of a page."""
    return _reparsed(spark, folder).select(
        "page_id", similarity.bleu_column(F.col("pred"), F.col("gt")).alias("bleu"), similarity.meteor_column(F.col("pred"), F.col("gt")).alias("meteor"), similarity.rouge_l_column(F.col("pred"), F.col("gt")).alias("rouge_l")
    )


@query("teds_tables")
def teds_tables(spark, folder):
    """Tree edit similarity between the tables of two parses of a page; null where the first parse has none (the sentinel -1)."""
    order = Window.partitionBy("pdf_path", "page_num").orderBy("parsed_at", "page_id")
    pages = table(spark, folder, "pages", "page_id", "pdf_path", "page_num", "markdown", "parsed_at")
    html = layout.markdown_tables(pages.select("page_id", "markdown"), "page_id", "markdown").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "html"))), lambda t: t["html"]), "").alias("html"))
    both = pages.select("page_id", F.row_number().over(order).alias("rn"), F.first("page_id").over(order).alias("gt_id")).where("rn > 1")
    pairs = both.join(html.withColumnRenamed("html", "pred"), "page_id", "left").join(html.select(F.col("page_id").alias("gt_id"), F.col("html").alias("gt")), "gt_id", "left")
    return pairs.select("page_id", F.nullif(similarity.teds_column(F.col("pred"), F.col("gt")), F.lit(-1.0)).alias("teds"))


@query(
    "string_metrics",
    f"""WITH z AS (SELECT answer_id, coalesce(answer, '') AS a, coalesce(text, '') AS q FROM answers JOIN queries USING (query_id))
SELECT answer_id, a = q AS exact_match, contains(lower(a), lower(q)) AND q <> '' AS presence, CASE WHEN greatest(length({_ascii('a')}), length({_ascii('q')})) = 0 THEN 1.0 ELSE round(1 - levenshtein({_ascii('a')}, {_ascii('q')}) / greatest(length({_ascii('a')}), length({_ascii('q')})), 6) END AS similarity FROM z""",
)
def string_metrics(spark, folder):
    a, q = F.coalesce("answer", F.lit("")), F.coalesce("text", F.lit(""))
    pairs = table(spark, folder, "answers", "answer_id", "query_id", "answer").join(table(spark, folder, "queries", "query_id", "text"), "query_id").select("answer_id", a.alias("a"), q.alias("q"))
    x, y = T.ascii_only(F.col("a")), T.ascii_only(F.col("q"))
    longest = F.greatest(F.length(x), F.length(y))
    return pairs.select("answer_id", (F.col("a") == F.col("q")).alias("exact_match"), (F.contains(F.lower("a"), F.lower("q")) & (F.col("q") != "")).alias("presence"), F.when(longest == 0, F.lit(1.0)).otherwise(F.round(1 - F.levenshtein(x, y) / longest, 6)).alias("similarity"))
