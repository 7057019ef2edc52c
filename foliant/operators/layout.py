"""Pages, tables and layout blocks of parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T


def markdown_tables(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Pipe tables as HTML: ``key``, table_no, n_rows, html. Rules between header and body are dropped; any other line ends a table."""
    lines = texts.where(F.col(text).contains("|")).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("s", T.strip_ends(F.col("line")))
    is_row = F.col("s").rlike(r"^\|(?:.*\|)?$") & (F.length("s") > 1)
    gaps = lines.withColumn("is_row", is_row).withColumn("island", F.sum(F.when(is_row, 0).otherwise(1)).over(Window.partitionBy(key).orderBy("pos")))
    rows = gaps.where(F.col("is_row") & ~F.col("s").rlike(r"^\|?[\s:|-]*\|?$")).withColumn("cells", F.transform(F.split(F.regexp_replace("s", r"^\||\|$", ""), r"\|"), T.strip_ends))
    first = F.row_number().over(Window.partitionBy(key, "island").orderBy("pos")) == 1
    tag = rows.withColumn("tag", F.when(first, "th").otherwise("td"))
    cell = lambda c: F.concat(F.lit("<"), "tag", F.lit(">"), T.escape_html(c), F.lit("</"), "tag", F.lit(">"))
    html = tag.withColumn("tr", F.concat(F.lit("<tr>"), F.array_join(F.transform("cells", cell), ""), F.lit("</tr>")))
    grouped = html.groupBy(key, "island").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("pos", "tr"))).alias("trs"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("island"))
    return grouped.select(key, number.alias("table_no"), "n_rows", F.concat(F.lit("<html><body><table>"), F.array_join(F.transform("trs", lambda t: t["tr"]), ""), F.lit("</table></body></html>")).alias("html"))


#: Categories of layout labels; others are paragraphs.
CATEGORY = {"paragraph_title": "heading1", "image": "figure", "chart": "figure", "footer": "footer", "number": "footer", "list": "list", "table": "table", "code": "code", "header": "header"}


def block_html(label: Column, content: Column) -> Column:
    e = T.escape_html(content)
    around = lambda a, b: F.concat(F.lit(a), e, F.lit(b))
    items = F.concat(F.lit("<ul><li>"), F.replace(e, F.lit("\n"), F.lit("</li><li>")), F.lit("</li></ul>"))
    return (
        F.when(label == "paragraph_title", around("<h1>", "</h1>")).when(label == "list", items).when(label.isin("image", "chart"), around("<figure>", "</figure>")).when(label == "code", around("<pre>", "</pre>"))
        .when(label == "header", around("<header>", "</header>")).when(label.isin("footer", "number"), around("<footer>", "</footer>")).otherwise(around("<p>", "</p>"))
    )


def elements(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """Blocks as elements, numbered through each document in reading order, with corners on the unit square.

    Blocks without a label or content are skipped; without four box figures, or on a page without size, the corners are null.
    """
    good = blocks.where("block_label IS NOT NULL AND block_content IS NOT NULL")
    order = Window.partitionBy("pdf_path").orderBy("page_num", "block_order", "block_key")
    corner = lambda i, size: F.when((F.size("block_bbox") == 4) & (F.lit(size) > 0), F.round(F.get("block_bbox", F.lit(i)) / size, 4))
    category = F.coalesce(F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])[F.col("block_label")], F.lit("paragraph"))
    return good.select(
        "pdf_path", "block_key", (F.row_number().over(order) - 1).alias("id"), category.alias("category"), F.col("page_num").alias("page"), block_html(F.col("block_label"), F.col("block_content")).alias("html"),
        corner(0, width).alias("x0"), corner(1, height).alias("y0"), corner(2, width).alias("x1"), corner(3, height).alias("y1"),
    )


def join_pages(pages: DataFrame) -> DataFrame:
    """One text a document: its pages in order, each under a numbered header; of a page parsed again, the first parse."""
    first = pages.groupBy("pdf_path", "page_num").agg(F.min_by("markdown", F.struct("parsed_at", "page_id")).alias("markdown"))
    listed = first.groupBy("pdf_path").agg(F.count("*").alias("pages"), F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("markdown", F.lit("")).alias("md")))).alias("ps"))
    part = F.transform("ps", lambda p: F.concat(F.lit("# Page "), p["page_num"].cast("string"), F.lit("\n\n"), p["md"]))
    return listed.select("pdf_path", "pages", F.array_join(part, "\n\n---\n\n").alias("combined"))


def split_pages(joined: DataFrame) -> DataFrame:
    """Back to one row a page, by the numbered headers; the rule after each page goes."""
    numbers = F.regexp_extract_all("combined", F.lit(r"(?md)^# Page (\d+)$"), F.lit(1))
    cut = joined.withColumn("all_parts", F.split("combined", r"(?md)^# Page \d+$"))
    parts = F.slice("all_parts", 2, F.size("all_parts"))
    pairs = cut.select("pdf_path", F.inline(F.arrays_zip(numbers.alias("num"), parts.alias("part"))).alias("num", "part"))
    return pairs.select("pdf_path", F.col("num").cast("int").alias("page_num"), T.strip_ends(F.regexp_replace(T.strip_ends(F.col("part")), r"(?:^|\n)---$", "")).alias("text"))


def overlap_ratio(a: list[str], b: list[str], over: str) -> Column:
    """Intersection of two boxes over their union, the smaller or the larger area; 0 where that area is 0."""
    ax0, ay0, ax1, ay1 = map(F.col, a)
    bx0, by0, bx1, by1 = map(F.col, b)
    common = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0)) * F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    s, t = (ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0)
    area = {"union": s + t - common, "small": F.least(s, t), "large": F.greatest(s, t)}[over]
    return F.when(area > 0, F.round(common / area, 6)).otherwise(F.lit(0.0))


def overlapping(boxes: DataFrame, group: list[str], key: str, cell: float = 100.0) -> DataFrame:
    """Pairs of boxes of a group (``key`` of the first less than of the second) that share an area, with their three overlap ratios.

    Boxes (x0, y0, x1, y1) meet in the cells of a grid that they touch, and a pair counts in the cell that holds the corner of its common area, so no
    pair arises twice and boxes that lie apart aren't compared. Boxes without an area or with a null meet none.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    good = boxes.where("x1 > x0 AND y1 > y0").select(*group, key, "x0", "y0", "x1", "y1").select("*", cells("x0", "x1").alias("cx")).select("*", cells("y0", "y1").alias("cy"))
    other = good.select(*group, "cx", "cy", F.col(key).alias("other"), *[F.col(c).alias(f"n{c}") for c in ("x0", "y0", "x1", "y1")])
    corner = (F.floor(F.greatest("x0", "nx0") / cell) == F.col("cx")) & (F.floor(F.greatest("y0", "ny0") / cell) == F.col("cy"))
    met = good.join(other, [*group, "cx", "cy"]).where((F.col(key) < F.col("other")) & corner).where("least(x1, nx1) > greatest(x0, nx0) AND least(y1, ny1) > greatest(y0, ny0)")
    return met.select(*group, key, "other", *[overlap_ratio("x0 y0 x1 y1".split(), "nx0 ny0 nx1 ny1".split(), over).alias(f"over_{over}") for over in ("union", "small", "large")])


def enclosing(boxes: DataFrame, group: list[str]) -> DataFrame:
    """The smallest box around all boxes of a group."""
    return boxes.groupBy(*group).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("boxes"))
