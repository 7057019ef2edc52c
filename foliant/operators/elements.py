"""Layout blocks by label as HTML, markdown and text, with their place on the page, and whole documents of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import html as H
from foliant.functions import text as T

#: Labels by how their content is written.
TABLES = ("table",)
FIGURES = ("image", "figure", "flowchart", "seal", "header_image", "footer_image")
CHARTS = ("chart",)
EQUATIONS = ("formula", "algorithm", "formula_number")
TITLES = {"doc_title": "h1", "paragraph_title": "h2", "abstract_title": "h2", "reference_title": "h2", "content_title": "h2"}
#: Tags of other labels; any label that isn't named is a paragraph.
TAGS = {"aside_text": "aside", "header": "header", "footer": "footer", "number": "span", "table_title": "figcaption", "chart_title": "figcaption", "figure_title": "figcaption", "figure_table_chart_title": "figcaption"}
FIGURE = '<figure><img src="/image/placeholder" /></figure>'


def _named(label: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[label]


def contents(blocks: DataFrame, label: str = "block_label", content: str = "block_content") -> DataFrame:
    """``blocks`` with ``html``, ``markdown`` and ``text``; blocks without a label or content are left out, empty content stays."""
    kind, raw = F.col(label), F.col(content)
    good = blocks.where((kind != "") & raw.isNotNull())
    holds_table = F.contains(F.lower(raw), F.lit("<table"))
    inside = lambda tag, attributes="": F.concat(F.lit("<"), tag, F.lit(attributes + ">"), T.escape_html(raw), F.lit("</"), tag, F.lit(">"))
    html = (
        F.when(kind.isin(*TABLES), F.when(holds_table, raw).otherwise(F.concat(F.lit("<table><tr><td>"), T.escape_html(raw), F.lit("</td></tr></table>"))))
        .when(kind.isin(*CHARTS) & holds_table, raw)
        .when(kind.isin(*FIGURES, *CHARTS), FIGURE)
        .when(kind.isin(*EQUATIONS), inside(F.lit("p"), ' class="equation"'))
        .otherwise(inside(F.coalesce(_named(kind, TITLES | TAGS), F.lit("p"))))
    )
    good = good.withColumn("html", html)
    hashes = F.when(_named(kind, TITLES) == "h1", "# ").otherwise("## ")
    markdown = (
        F.when(kind.isin(*TABLES) | (kind.isin(*CHARTS) & holds_table), H.simple_markdown(F.col("html")))
        .when(kind.isin(*TITLES), F.concat(hashes, raw))
        .when(kind.isin(*FIGURES, *CHARTS), "![image](/image/placeholder)")
        .when(kind.isin(*EQUATIONS), F.when(T.strip_ends(raw) == "", "").otherwise(F.concat(F.lit("$$"), raw, F.lit("$$"))))
        .otherwise(raw)
    )
    return good.withColumn("markdown", markdown).withColumn("text", T.strip_html(F.col("html")))


def corners(box: Column, width: Column, height: Column) -> Column:
    """Four corners on the unit square, clockwise from the top left; 0 where the page has no size. Null for a box without four figures."""
    at = lambda i, size: F.when(size > 0, F.round(F.get(box, F.lit(i)) / size, 4)).otherwise(F.lit(0.0))
    point = lambda i, j: F.struct(at(i, width).alias("x"), at(j, height).alias("y"))
    return F.when(F.size(box) == 4, F.array(point(0, 1), point(2, 1), point(2, 3), point(0, 3)))


def shifted(blocks: DataFrame, start: int, page: str = "page_num") -> DataFrame:
    """Pages of a part numbered through the whole document: ``start`` pages stand before the part."""
    return blocks.withColumn(page, F.col(page) + F.lit(start))


def documents(blocks: DataFrame) -> DataFrame:
    """A document's three texts in reading order, its number of pages and of elements."""
    made = contents(blocks).select("pdf_path", "page_num", F.struct("page_num", "block_order", "block_key", "html", "markdown", "text").alias("e"))
    listed = made.groupBy("pdf_path").agg(F.max("page_num").alias("pages"), F.count("*").alias("elements"), F.array_sort(F.collect_list("e")).alias("es"))
    joined = lambda name, between: F.array_join(F.transform("es", lambda e: e[name]), between).alias(name)
    return listed.select("pdf_path", "pages", "elements", joined("html", "\n"), joined("markdown", "\n\n"), joined("text", "\n"))
