"""Markdown, layout and chunk queries over pages and blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chunking, layout
from foliant.plans.base import query, strip
from foliant.sources import readers
from foliant.sources.tables import table


@query(
    "text_ids",
    """SELECT page_id, substring(sha256(pdf_path), 1, 12) AS doc_id, 'page_' || substring(md5(markdown), 1, 12) AS text_id, substring(sha256(markdown), 1, 16) AS cache_key,
  substring(lower(replace(replace(replace(backend || '-' || regexp_extract(pdf_path, '([^/]+)\\.pdf$', 1), '_', '-'), '+', '-'), '.', '-')), 1, 63) AS label FROM pages""".replace("\\\\", "\\"),
)
def text_ids(spark, folder):
    stem = F.regexp_extract("pdf_path", r"([^/]+)\.pdf$", 1)
    label = F.substring(F.lower(F.translate(F.concat("backend", F.lit("-"), stem), "_+.", "---")), 1, 63)
    return table(spark, folder, "pages", "page_id", "pdf_path", "backend", "markdown").select(
        "page_id", chunking.document_id(F.col("pdf_path")).alias("doc_id"), chunking.text_id(F.col("markdown"), "page").alias("text_id"), chunking.cache_key(F.col("markdown")).alias("cache_key"), label.alias("label")
    )


_ROW = f"'| ' || array_to_string(list_transform(string_split(regexp_replace({strip('l')}, '^\\||\\|$', '', 'g'), '|'), lambda x: {strip('x')}), ' | ') || ' |'"
NORMAL = rf"""
WITH a AS (SELECT page_id, markdown, regexp_replace(markdown, '(?ms)^```(?:markdown|md)?\s*\n(.*?)^```\s*$', '\1', 'g') AS f FROM pages),
b AS (SELECT *, regexp_replace(f, '<\|[A-Z_]+\d*\|>', '', 'g') AS l FROM a),
c AS (SELECT *, regexp_replace(l, '(?m)^(\s*)[*+•](\s)', '\1-\2', 'g') AS bu FROM b),
d AS (SELECT *, regexp_replace(bu, '(?m)^(#{{1,6}}\s+)\*\*(.+?)\*\*\s*$', '\1\2', 'g') AS h FROM c),
e AS (SELECT *, regexp_replace(h, '(?m)^>\s?(.*)$', '\1', 'g') AS q FROM d),
t AS (SELECT *, array_to_string(list_transform(string_split(q, chr(10)), lambda l: CASE WHEN regexp_matches({strip('l')}, '^\|(?:.*\|)?$') AND length({strip('l')}) > 1 THEN {_ROW} ELSE l END), chr(10)) AS ta FROM e),
w AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(ta, '[ \t]+', ' ', 'g'), '(?m) +$', '', 'g'), '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS co FROM t),
n AS (SELECT page_id, markdown, {strip('co')} AS text,
  CAST(length(regexp_extract_all(markdown, '(?ms)^```(?:markdown|md)?\s*\n(.*?)^```\s*$')) AS INTEGER) AS fences, CAST(length(regexp_extract_all(f, '<\|[A-Z_]+\d*\|>')) AS INTEGER) AS locations,
  CAST(length(regexp_extract_all(l, '(?m)^(\s*)[*+•](\s)')) AS INTEGER) AS bullets, CAST(length(regexp_extract_all(bu, '(?m)^(#{{1,6}}\s+)\*\*(.+?)\*\*\s*$')) AS INTEGER) AS headers,
  CAST(length(regexp_extract_all(h, '(?m)^>\s?(.*)$')) AS INTEGER) AS quotes, CAST(ta <> q AS INTEGER) AS tables, CAST(co <> ta AS INTEGER) AS blanks FROM w)
"""
RULES = ("fences", "locations", "bullets", "headers", "quotes", "tables", "blanks")


@query("normalize_markdown", NORMAL + "SELECT page_id, text, " + ", ".join(RULES) + " FROM n")
def normalize_markdown(spark, folder):
    columns = T.normalize_markdown(F.col("markdown"))
    return table(spark, folder, "pages", "page_id", "markdown").select("page_id", *[c.alias(k) for k, c in columns.items()])


@query(
    "normalization_log",
    NORMAL
    + ", u AS (UNPIVOT (SELECT page_id, "
    + ", ".join(RULES)
    + " FROM n) ON "
    + ", ".join(RULES)
    + " INTO NAME rule VALUE changes) SELECT rule, count(*) AS pages, CAST(sum(changes) AS BIGINT) AS changes FROM u WHERE changes > 0 GROUP BY rule",
)
def normalization_log(spark, folder):
    counted = normalize_markdown(spark, folder).select("page_id", *RULES).unpivot(["page_id"], list(RULES), "rule", "changes")
    return counted.where("changes > 0").groupBy("rule").agg(F.count("*").alias("pages"), F.sum("changes").alias("changes"))


@query(
    "structure_flags",
    r"""SELECT page_id, regexp_matches(markdown, '(?m)^#{1,4}\s') AS has_headers, contains(markdown, '|') AS has_tables, contains(markdown, '$') AS has_formulas, contains(markdown, '```') AS has_code,
  CAST(length(list_filter(regexp_split_to_array(markdown, '[\s\x0B]+'), lambda w: w <> '')) AS INTEGER) AS word_count, CAST(length(string_split(markdown, chr(10))) AS INTEGER) AS line_count FROM pages WHERE markdown IS NOT NULL""",
)
def structure_flags(spark, folder):
    return table(spark, folder, "pages", "page_id", "markdown").where("markdown IS NOT NULL").select("page_id", *[c.alias(k) for k, c in T.structure(F.col("markdown")).items()])


_IS_ROW = "regexp_matches(s, '^\\|(?:.*\\|)?$') AND length(s) > 1"
@query(
    "md_tables",
    rf"""
WITH l AS (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS pos FROM pages WHERE markdown IS NOT NULL),
s AS (SELECT page_id, pos, {strip('line')} AS s FROM l),
g AS (SELECT *, {_IS_ROW} AS is_row, sum(CASE WHEN {_IS_ROW} THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS island FROM s),
r AS (SELECT page_id, island, pos, list_transform(string_split(regexp_replace(s, '^\||\|$', '', 'g'), '|'), lambda x: {strip('x')}) AS cells FROM g WHERE is_row AND NOT regexp_matches(s, '^\|?[\s:|-]*\|?$')),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, island ORDER BY pos) AS rn FROM r),
h AS (SELECT *, '<tr>' || array_to_string(list_transform(cells, lambda c: (CASE WHEN rn = 1 THEN '<th>' ELSE '<td>' END) || replace(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || (CASE WHEN rn = 1 THEN '</th>' ELSE '</td>' END)), '') || '</tr>' AS tr FROM n)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY island) AS INTEGER) AS table_no, CAST(count(*) AS BIGINT) AS n_rows, '<html><body><table>' || string_agg(tr, '' ORDER BY pos) || '</table></body></html>' AS html
FROM h GROUP BY page_id, island""",
)
def md_tables(spark, folder):
    return layout.markdown_tables(table(spark, folder, "pages", "page_id", "markdown"), "page_id", "markdown")


_BLOCK = "SELECT block_key, pdf_path, page_num, block_order, block_label, block_content, block_bbox FROM blocks WHERE block_label IS NOT NULL AND block_content IS NOT NULL"
_ESC = "replace(replace(replace(replace(replace(block_content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_HTML = f"""CASE WHEN block_label = 'paragraph_title' THEN '<h1>' || {_ESC} || '</h1>' WHEN block_label = 'list' THEN '<ul><li>' || replace({_ESC}, chr(10), '</li><li>') || '</li></ul>'
  WHEN block_label IN ('image', 'chart') THEN '<figure>' || {_ESC} || '</figure>' WHEN block_label = 'code' THEN '<pre>' || {_ESC} || '</pre>' WHEN block_label = 'header' THEN '<header>' || {_ESC} || '</header>'
  WHEN block_label IN ('footer', 'number') THEN '<footer>' || {_ESC} || '</footer>' ELSE '<p>' || {_ESC} || '</p>' END"""
_CATEGORY = "CASE WHEN block_label = 'paragraph_title' THEN 'heading1' WHEN block_label IN ('image', 'chart') THEN 'figure' WHEN block_label IN ('footer', 'number') THEN 'footer' WHEN block_label IN ('list', 'table', 'code', 'header') THEN block_label ELSE 'paragraph' END"


@query(
    "layout_elements",
    f"""SELECT pdf_path, block_key, CAST(row_number() OVER (PARTITION BY pdf_path ORDER BY page_num, block_order, block_key) - 1 AS INTEGER) AS id, {_CATEGORY} AS category, page_num AS page, {_HTML} AS html,
  CASE WHEN length(block_bbox) = 4 THEN round(block_bbox[1] / 1000.0, 4) END AS x0, CASE WHEN length(block_bbox) = 4 THEN round(block_bbox[2] / 1400.0, 4) END AS y0,
  CASE WHEN length(block_bbox) = 4 THEN round(block_bbox[3] / 1000.0, 4) END AS x1, CASE WHEN length(block_bbox) = 4 THEN round(block_bbox[4] / 1400.0, 4) END AS y1 FROM ({_BLOCK})""",
)
def layout_elements(spark, folder):
    return layout.elements(table(spark, folder, "blocks"), 1000.0, 1400.0)


@query(
    "strip_html",
    rf"""SELECT block_key, {strip(r"regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\s\x0B]+', ' ', 'g')")} AS text FROM (SELECT block_key, {_HTML} AS html FROM ({_BLOCK}))""",
)
def strip_html(spark, folder):
    return layout_elements(spark, folder).select("block_key", T.strip_html(F.col("html")).alias("text"))


_MD = "html"
for _n in range(1, 7):
    _MD = f"regexp_replace({_MD}, '(?is)<h{_n}[^>]*>(.*?)</h{_n}>', chr(10) || '{'#' * _n} \\1' || chr(10), 'g')"
_MD = f"regexp_replace({_MD}, '(?is)<li[^>]*>(.*?)</li>', chr(10) || '- \\1', 'g')"
_MD = f"regexp_replace({_MD}, '(?is)<p[^>]*>(.*?)</p>', chr(10) || '\\1' || chr(10), 'g')"
_MD = f"regexp_replace({_MD}, '(?is)<figure[^>]*>(.*?)</figure>', chr(10) || '[figure] \\1' || chr(10), 'g')"
_MD = f"replace(replace(replace(replace(replace(replace(regexp_replace({_MD}, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"


@query("html_to_markdown", f"SELECT block_key, {strip(f'''regexp_replace({_MD}, '\\n{{3,}}', chr(10) || chr(10), 'g')''')} AS markdown FROM (SELECT block_key, {_HTML} AS html FROM ({_BLOCK}))")
def html_to_markdown(spark, folder):
    return layout_elements(spark, folder).select("block_key", T.html_to_markdown(F.col("html")).alias("markdown"))


_FIRST = "SELECT *, row_number() OVER (PARTITION BY pdf_path, page_num ORDER BY parsed_at, page_id) AS rn FROM pages"
_JOINED = f"SELECT pdf_path, CAST(count(*) AS BIGINT) AS pages, string_agg('# Page ' || page_num || chr(10) || chr(10) || coalesce(markdown, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page_num) AS combined FROM ({_FIRST}) WHERE rn = 1 GROUP BY pdf_path"


@query("page_join", _JOINED)
def page_join(spark, folder):
    return layout.join_pages(table(spark, folder, "pages", "page_id", "pdf_path", "page_num", "markdown", "parsed_at"))


@query(
    "page_split",
    rf"""WITH j AS ({_JOINED}), p AS (SELECT pdf_path, unnest(regexp_extract_all(combined, '(?m)^# Page (\d+)$', 1)) AS num, unnest(regexp_split_to_array(combined, '(?m)^# Page \d+$')[2:]) AS part FROM j)
SELECT pdf_path, CAST(num AS INTEGER) AS page_num, {strip(f"regexp_replace({strip('part')}, '(?:^|\n)---$', '')")} AS text FROM p""",
)
def page_split(spark, folder):
    return layout.split_pages(page_join(spark, folder))


_CHUNKS = f"""
WITH src AS (SELECT page_id, pdf_path, page_num, markdown, bbox_data, chunk_size AS sz, chunk_overlap AS ov, separator AS sep FROM pages JOIN chunk_configs USING (config_id) WHERE {strip('markdown')} <> ''),
fold AS (SELECT *, list_reduce(list_prepend({{'cur': '', 'out': CAST([] AS VARCHAR[])}}, list_transform(string_split(markdown, sep), lambda p: {{'cur': p, 'out': CAST([] AS VARCHAR[])}})),
  lambda a, b: CASE WHEN length(a.cur) + length(b.cur) + length(sep) > sz AND a.cur <> ''
    THEN {{'cur': CASE WHEN ov > 0 THEN right(a.cur, ov) || sep || b.cur ELSE b.cur END, 'out': list_append(a.out, {strip('a.cur')})}}
    ELSE {{'cur': CASE WHEN a.cur <> '' THEN a.cur || sep || b.cur ELSE b.cur END, 'out': a.out}} END) AS acc FROM src),
done AS (SELECT page_id, pdf_path, page_num, bbox_data, CASE WHEN {strip('acc.cur')} <> '' THEN list_append(acc.out, {strip('acc.cur')}) ELSE acc.out END AS chunks FROM fold),
chunked AS (SELECT page_id, substring(sha256(pdf_path), 1, 12) AS doc_id, page_num, bbox_data, unnest(chunks) AS chunk_text, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS idx FROM done),
named AS (SELECT *, 'p' || page_num || '_c' || idx AS chunk_id FROM chunked)
"""


@query("chunk_pages", _CHUNKS + "SELECT page_id, doc_id, page_num, chunk_id, idx, chunk_text FROM named")
def chunk_pages(spark, folder):
    return _chunks(spark, folder).drop("bbox_data")


def _chunks(spark, folder):
    return chunking.chunk_pages(table(spark, folder, "pages", "page_id", "pdf_path", "page_num", "config_id", "markdown", "bbox_data"), table(spark, folder, "chunk_configs"))


@query(
    "chunk_bbox",
    _CHUNKS
    + rf""", w AS (SELECT *, list_transform(list_filter(regexp_split_to_array(chunk_text, '[\s\x0B]+'), lambda x: x <> ''), lambda x: lower(x)) AS ws FROM named),
h AS (SELECT page_id, chunk_id, list_filter(bbox_data, lambda b: list_contains(ws, lower({strip('b.text')}))) AS hits FROM w)
SELECT page_id, chunk_id, list_min(list_transform(hits, lambda b: b.x0)) AS x0, list_min(list_transform(hits, lambda b: b.y0)) AS y0, list_max(list_transform(hits, lambda b: b.x1)) AS x1, list_max(list_transform(hits, lambda b: b.y1)) AS y1 FROM h""",
)
def chunk_bbox(spark, folder):
    return chunking.chunk_boxes(_chunks(spark, folder))


@query("parent_child_chunks")
def parent_child_chunks(spark, folder):
    corpus = table(spark, folder, "corpus", "corpus_key", "title", "text")
    return chunking.child_chunks(corpus.select("corpus_key", F.concat_ws("\n\n", "title", "text").alias("content")), "corpus_key", "content")


# prefixes that are known: the titles of the parents that have one, by the hash of the first chunk of their text
_PARENTS = "SELECT doc_id AS parent_id, min_by(coalesce(text, ''), corpus_key) AS parent_text, min_by(coalesce(title, ''), corpus_key) AS title FROM corpus GROUP BY doc_id"
_PIECES = f"SELECT parent_id, title, unnest(list_filter(string_split(parent_text, chr(10) || chr(10)), lambda x: x <> '')) AS chunk_text, CAST(generate_subscripts(list_filter(string_split(parent_text, chr(10) || chr(10)), lambda x: x <> ''), 1) - 1 AS INTEGER) AS idx FROM parents"
_ENRICH = f"""
WITH parents AS ({_PARENTS}), chunks AS ({_PIECES}),
cache AS (SELECT substring(sha256(chunk_text), 1, 16) AS hash, min(title) AS prefix FROM chunks WHERE idx = 0 AND title <> '' GROUP BY 1),
e AS (SELECT c.parent_id, idx, chunk_text, CASE WHEN coalesce(prefix, '') <> '' THEN 'cached' WHEN parent_text = '' THEN 'orphan' ELSE 'missing' END AS status,
  CASE WHEN coalesce(prefix, '') <> '' THEN prefix || chr(10) || chr(10) || chunk_text ELSE chunk_text END AS enriched_text, CASE WHEN coalesce(prefix, '') <> '' THEN chunk_text END AS original_content
  FROM chunks c LEFT JOIN parents p ON c.parent_id = p.parent_id LEFT JOIN cache ON substring(sha256(chunk_text), 1, 16) = hash)
"""


def _enriched(spark, folder):
    first = table(spark, folder, "corpus", "doc_id", "corpus_key", "title", "text").groupBy(F.col("doc_id").alias("parent_id")).agg(
        F.min_by(F.coalesce("text", F.lit("")), "corpus_key").alias("parent_text"), F.min_by(F.coalesce("title", F.lit("")), "corpus_key").alias("title")
    )
    chunks = first.select("parent_id", "title", F.posexplode(F.filter(F.split("parent_text", "\n\n"), lambda x: x != "")).alias("idx", "chunk_text"))
    cache = chunks.where("idx = 0 AND title <> ''").groupBy(chunking.cache_key(F.col("chunk_text")).alias("hash")).agg(F.min("title").alias("prefix"))
    return chunking.enrich(chunks, first, cache)


@query("contextual_enrich", _ENRICH + "SELECT * FROM e")
def contextual_enrich(spark, folder):
    return _enriched(spark, folder)


@query("enrichment_stats", _ENRICH + "SELECT status, count(*) AS chunks FROM e GROUP BY status")
def enrichment_stats(spark, folder):
    return _enriched(spark, folder).groupBy("status").agg(F.count("*").alias("chunks"))


@query("restore_original", _ENRICH + "SELECT parent_id, idx, coalesce(nullif(original_content, ''), enriched_text) AS text FROM e")
def restore_original(spark, folder):
    return _enriched(spark, folder).select("parent_id", "idx", F.coalesce(F.nullif("original_content", F.lit("")), "enriched_text").alias("text"))


@query(
    "bbox_overlap",
    """WITH b AS (SELECT DISTINCT pdf_path, page_num, block_order, block_bbox[1] AS x0, block_bbox[2] AS y0, block_bbox[3] AS x1, block_bbox[4] AS y1 FROM blocks WHERE length(block_bbox) = 4),
n AS (SELECT *, row_number() OVER (PARTITION BY pdf_path, page_num ORDER BY block_order, x0, y0, x1, y1) AS rn FROM b),
p AS (SELECT a.pdf_path, a.page_num, CAST(a.rn AS INTEGER) AS rn, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (c.x1 - c.x0) * (c.y1 - c.y0) AS t FROM n a JOIN n c ON a.pdf_path = c.pdf_path AND a.page_num = c.page_num AND c.rn = a.rn + 1)
SELECT pdf_path, page_num, rn, CASE WHEN s + t - i > 0 THEN round(i / (s + t - i), 6) ELSE 0 END AS over_union, CASE WHEN least(s, t) > 0 THEN round(i / least(s, t), 6) ELSE 0 END AS over_small, CASE WHEN greatest(s, t) > 0 THEN round(i / greatest(s, t), 6) ELSE 0 END AS over_large FROM p""",
)
def bbox_overlap(spark, folder):
    boxes = table(spark, folder, "blocks").where(F.size("block_bbox") == 4).select("pdf_path", "page_num", "block_order", *[F.col("block_bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]).distinct()
    order = Window.partitionBy("pdf_path", "page_num").orderBy("block_order", "x0", "y0", "x1", "y1")
    pairs = boxes.select("*", F.row_number().over(order).alias("rn"), *[F.lead(n).over(order).alias(f"n{n}") for n in ("x0", "y0", "x1", "y1")]).where("nx0 IS NOT NULL")
    return pairs.select("pdf_path", "page_num", "rn", *[layout.overlap_ratio("x0 y0 x1 y1".split(), "nx0 ny0 nx1 ny1".split(), over).alias(f"over_{over}") for over in ("union", "small", "large")])


@query(
    "response_pages",
    """WITH e AS (SELECT pdf_path, page_num, page_id, coalesce(nullif(CASE WHEN backend = 'upstage' THEN markdown ELSE '' END, ''), nullif(markdown, '')) AS c FROM pages)
SELECT pdf_path, page_num, string_agg(c, chr(10) || chr(10) ORDER BY page_id) AS markdown FROM e WHERE c IS NOT NULL GROUP BY ALL""",
)
def response_pages(spark, folder):
    """A JSON response for each page (markdown only from one backend, text from all), flattened again with the fallback."""
    body = F.to_json(F.struct(F.array(F.struct(F.col("page_num").alias("page"), F.struct(F.when(F.col("backend") == "upstage", F.col("markdown")).otherwise("").alias("markdown"), F.col("markdown").alias("text")).alias("content"))).alias("elements")))
    answers = table(spark, folder, "pages", "page_id", "pdf_path", "page_num", "backend", "markdown").select("page_id", "pdf_path", body.alias("body"))
    flat = readers.response_pages(answers.select(F.struct("pdf_path", "page_id").alias("k"), "body"), "k", "body")
    listed = flat.groupBy("k.pdf_path", "page_num").agg(F.array_sort(F.collect_list(F.struct("k.page_id", "markdown"))).alias("ms"))
    return listed.select("pdf_path", "page_num", F.array_join(F.transform("ms", lambda m: m["markdown"]), "\n\n").alias("markdown"))


@query("block_range", "SELECT block_key, page_num, block_label AS label, block_content AS content FROM blocks WHERE block_label IS NOT NULL AND page_num BETWEEN 2 AND 5")
def block_range(spark, folder):
    return readers.raw_blocks(table(spark, folder, "blocks"), 2, 5).select("block_key", "page_num", "label", "content")


@query(
    "document_layout",
    f"""WITH e AS (SELECT pdf_path, row_number() OVER (PARTITION BY pdf_path ORDER BY page_num, block_order, block_key) AS id, page_num AS page, {_HTML} AS html FROM ({_BLOCK}))
SELECT pdf_path, max(page) AS pages, count(*) AS elements, string_agg(html, chr(10) ORDER BY id) AS html FROM e GROUP BY pdf_path""",
)
def document_layout(spark, folder):
    """A document's elements as one text in reading order."""
    e = layout_elements(spark, folder).groupBy("pdf_path").agg(F.max("page").alias("pages"), F.count("*").alias("elements"), F.array_sort(F.collect_list(F.struct("id", "html"))).alias("es"))
    return e.select("pdf_path", "pages", "elements", F.array_join(F.transform("es", lambda x: x["html"]), "\n").alias("html"))


@query("blank_chunks", _CHUNKS + f"SELECT page_id, count(*) AS chunks, CAST(sum(CASE WHEN {strip('chunk_text')} = '' THEN 1 ELSE 0 END) AS BIGINT) AS blank, CAST(sum(length(chunk_text)) AS BIGINT) AS chars FROM named GROUP BY page_id")
def blank_chunks(spark, folder):
    """Chunks of a page, those that indexing would leave out as blank, and characters."""
    chunks = chunk_pages(spark, folder)
    return chunks.groupBy("page_id").agg(F.count("*").alias("chunks"), F.count_if(T.strip_ends(F.col("chunk_text")) == "").alias("blank"), F.sum(F.length("chunk_text")).alias("chars"))
