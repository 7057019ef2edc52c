"""Blocks as elements, HTML tables as markdown, and what the presets ask for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import html as H
from foliant.operators import elements as E
from foliant.operators import layout
from foliant.operators import scoring as S
from foliant.operators import specs
from foliant.plans import metric_queries as M
from foliant.plans.analytics_queries import _RAGAS, _SCORES, _means, _scores
from foliant.plans.base import SQL, query, strip
from foliant.plans.text_queries import md_tables
from foliant.sources.tables import table

NL = "chr(10)"


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _table_sql(h: str, row: str = "r", cell: str = "c") -> str:
    """A pipe table of the HTML ``h``."""
    rows = f"list_transform(regexp_extract_all({h}, '(?s)<tr[^>]*>(.*?)</tr>', 1), lambda {row}: list_transform(regexp_extract_all({row}, '(?s)<(?:th|td)[^>]*>(.*?)</(?:th|td)>', 1), lambda {cell}: {strip(f'''regexp_replace({cell}, '<[^>]+>', '', 'g')''')}))"
    width = f"list_max(list_transform({rows}, lambda x: len(x)))"
    lines = f"list_transform({rows}, lambda y: '| ' || array_to_string(y || list_transform(range({width} - len(y)), lambda i: ''), ' | ') || ' |')"
    return f"CASE WHEN len({rows}) = 0 THEN {strip(f'''regexp_replace({h}, '<[^>]+>', ' ', 'g')''')} ELSE array_to_string([({lines})[1], '| ' || array_to_string(list_transform(range({width}), lambda i: '---'), ' | ') || ' |'] || ({lines})[2:], {NL}) END"


@query("html_tables_markdown", f"SELECT page_id, table_no, {_table_sql('html')} AS markdown FROM ({SQL['md_tables']})")
def html_tables_markdown(spark, folder):
    """The pages' tables as HTML and back to markdown."""
    return md_tables(spark, folder).select("page_id", "table_no", H.table_markdown(F.col("html")).alias("markdown"))


_ESC = "replace(replace(replace(replace(replace(block_content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_OWN = "contains(lower(block_content), '<table')"
_TAG = "CASE block_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in (E.TITLES | E.TAGS).items()) + " ELSE 'p' END"
_HTML = f"""CASE WHEN block_label IN {_in(E.TABLES)} THEN CASE WHEN {_OWN} THEN block_content ELSE '<table><tr><td>' || {_ESC} || '</td></tr></table>' END
  WHEN block_label IN {_in(E.CHARTS)} AND {_OWN} THEN block_content WHEN block_label IN {_in(E.FIGURES + E.CHARTS)} THEN '{E.FIGURE}'
  WHEN block_label IN {_in(E.EQUATIONS)} THEN '<p class="equation">' || {_ESC} || '</p>' ELSE '<' || {_TAG} || '>' || {_ESC} || '</' || {_TAG} || '>' END"""
_MARKDOWN = f"""CASE WHEN block_label IN {_in(E.TABLES)} OR block_label IN {_in(E.CHARTS)} AND {_OWN} THEN {strip(_table_sql('html'))} WHEN block_label = 'doc_title' THEN '# ' || block_content WHEN block_label IN {_in(E.TITLES)} THEN '## ' || block_content
  WHEN block_label IN {_in(E.FIGURES + E.CHARTS)} THEN '![image](/image/placeholder)' WHEN block_label IN {_in(E.EQUATIONS)} THEN CASE WHEN {strip('block_content')} = '' THEN '' ELSE '$$' || block_content || '$$' END ELSE block_content END"""
_TEXT = strip(r"regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[\s\x0B]+', ' ', 'g')")
_CONTENTS = f"SELECT *, {_MARKDOWN} AS markdown, {_TEXT} AS text FROM (SELECT *, {_HTML} AS html FROM blocks WHERE block_label <> '' AND block_content IS NOT NULL)"


@query("block_contents", f"SELECT block_key, html, markdown, text FROM ({_CONTENTS})")
def block_contents(spark, folder):
    return E.contents(table(spark, folder, "blocks", "block_key", "block_label", "block_content")).select("block_key", "html", "markdown", "text")


@query(
    "document_texts",
    f"""SELECT pdf_path, max(page_num) AS pages, count(*) AS elements, string_agg(html, {NL} ORDER BY page_num, block_order, block_key) AS html, string_agg(markdown, {NL} || {NL} ORDER BY page_num, block_order, block_key) AS markdown,
  string_agg(text, {NL} ORDER BY page_num, block_order, block_key) AS text FROM ({_CONTENTS}) GROUP BY pdf_path""",
)
def document_texts(spark, folder):
    """A document's blocks as one HTML, markdown and plain text."""
    return E.documents(table(spark, folder, "blocks", "block_key", "pdf_path", "page_num", "block_order", "block_label", "block_content"))


_CORNERS = ("tl", 1, 2), ("tr", 3, 2), ("br", 3, 4), ("bl", 1, 4)


@query(
    "block_corners",
    "SELECT block_key, page_num + 10 AS page, " + ", ".join(f"round(block_bbox[{i}] / 1000.0, 4) AS {n}_x, round(block_bbox[{j}] / 1400.0, 4) AS {n}_y" for n, i, j in _CORNERS) + " FROM blocks WHERE length(block_bbox) = 4",
)
def block_corners(spark, folder):
    """Corners of every block's box on a page of 1,000 by 1,400, for a part that starts behind ten pages."""
    blocks = E.shifted(table(spark, folder, "blocks", "block_key", "page_num", "block_bbox").where(F.size("block_bbox") == 4), 10)
    placed = blocks.select("block_key", F.col("page_num").alias("page"), E.corners(F.col("block_bbox"), F.lit(1000.0), F.lit(1400.0)).alias("c"))
    return placed.select("block_key", "page", *[F.col("c")[k][axis].alias(f"{n}_{axis}") for k, (n, _, _) in enumerate(_CORNERS) for axis in ("x", "y")])


_NAME = "regexp_extract(pdf_path, '([^/]+)$', 1)"


@query(
    "document_classes",
    f"""SELECT name, CASE WHEN name IN {_in(specs.TEXT_DOCUMENTS)} THEN 'text' WHEN name IN {_in(specs.TABLE_DOCUMENTS)} THEN 'table' WHEN name IN {_in(specs.GRAPH_DOCUMENTS)} THEN 'graph' ELSE 'unknown' END AS doc_class,
  CASE WHEN contains(name, '72dpi') THEN '72dpi' WHEN contains(name, '150dpi') THEN '150dpi' WHEN contains(name, '200dpi') THEN '200dpi' WHEN contains(name, '_image') AND NOT contains(name, 'dpi') THEN 'image' ELSE 'native' END AS resolution, pages
FROM (SELECT {_NAME} AS name, count(*) AS pages FROM pages GROUP BY ALL)""",
)
def document_classes(spark, folder):
    named = table(spark, folder, "pages", "pdf_path").groupBy(F.regexp_extract("pdf_path", "([^/]+)$", 1).alias("name")).agg(F.count("*").alias("pages"))
    return named.select("name", specs.document_class(F.col("name")).alias("doc_class"), specs.resolution_class(F.col("name")).alias("resolution"), "pages")


@query(
    "parsing_presets",
    "WITH s AS ("
    + " UNION ALL ".join(f"SELECT '{p}' AS preset, unnest({_list(b)}) AS backend, n AS pdf_name FROM (SELECT unnest({_list(d)}) AS n)" for p, (b, d) in specs.PARSING.items())
    + f"""), k AS (SELECT backend, count(*) AS parses FROM pages GROUP BY backend)
SELECT preset, backend, pdf_name, CASE {' '.join(f"WHEN pdf_name IN {_in(n)} THEN '{t}'" for t, n in specs.TRUTHS.items())} END AS gt_name, substring(backend || '-' || replace(replace(pdf_name, '.pdf', ''), '_', '-') || '-direct', 1, 63) AS label, coalesce(parses, 0) AS parses FROM s LEFT JOIN k USING (backend)""",
)
def parsing_presets(spark, folder):
    """The specs of every preset, with how many pages each backend has parsed so far."""
    asked = None
    for preset in specs.PARSING:
        rows = specs.parsing_specs(spark, preset).select(F.lit(preset).alias("preset"), "backend", "pdf_name", "gt_name", "label")
        asked = rows if asked is None else asked.unionByName(rows)
    done = table(spark, folder, "pages", "backend").groupBy("backend").agg(F.count("*").alias("parses"))
    return asked.join(done, "backend", "left").select("preset", "backend", "pdf_name", "gt_name", "label", F.coalesce("parses", F.lit(0)).alias("parses"))


@query(
    "retrieval_presets",
    "WITH s AS ("
    + " UNION ALL ".join(f"SELECT '{p}' AS preset, a, b, c, d FROM (SELECT unnest({_list(l[0])}) AS a), (SELECT unnest({_list(l[1])}) AS b), (SELECT unnest({_list(l[2])}) AS c), (SELECT unnest({_list(l[3])}) AS d)" for p, l in specs.RETRIEVAL.items())
    + """), k AS (SELECT strategy, count(*) AS runs FROM latency GROUP BY strategy), e AS (SELECT *, a || '+' || b || '+' || c || '+' || d AS label FROM s)
SELECT preset, label, 'hybrid_with_' || c || '_rerank_and_llm_support' AS retrieval_mode, a || ':' || b AS index_key, coalesce(runs, 0) AS runs FROM e LEFT JOIN k ON strategy = label""",
)
def retrieval_presets(spark, folder):
    """The combinations of every preset, with how often each has been run."""
    asked = None
    for preset in specs.RETRIEVAL:
        rows = specs.combinations(spark, preset).select(F.lit(preset).alias("preset"), "label", "retrieval_mode", "index_key")
        asked = rows if asked is None else asked.unionByName(rows)
    runs = table(spark, folder, "latency", "strategy").groupBy(F.col("strategy").alias("label")).agg(F.count("*").alias("runs"))
    return asked.join(runs, "label", "left").select("preset", "label", "retrieval_mode", "index_key", F.coalesce("runs", F.lit(0)).alias("runs"))


@query(
    "answer_stubs",
    """SELECT answer_id, CASE WHEN coalesce(len(citations), 0) = 0 THEN '관련 문서를 찾을 수 없습니다.' ELSE '다음 ' || len(citations) || '개 출처에서 관련 내용을 찾았습니다:' || chr(10) || chr(10)
  || array_to_string(list_transform(citations, lambda c, i: '[' || i || '] ' || coalesce(c.source_path, '') || ' 페이지 ' || coalesce(CAST(c.page_number AS VARCHAR), '')), chr(10)) END AS answer FROM answers""",
)
def answer_stubs(spark, folder):
    """An answer made of its numbered sources, or the text for none."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    line = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), text(c["source_path"]), F.lit(" 페이지 "), text(c["page_number"]))
    found = F.concat(F.lit("다음 "), F.size("citations").cast("string"), F.lit("개 출처에서 관련 내용을 찾았습니다:\n\n"), F.array_join(F.transform("citations", line), "\n"))
    return table(spark, folder, "answers", "answer_id", "citations").select("answer_id", F.when(F.size("citations") > 0, found).otherwise("관련 문서를 찾을 수 없습니다.").alias("answer"))


@query("first_queries", "SELECT query_key, query_id, lang FROM queries WHERE text IS NOT NULL ORDER BY query_key LIMIT 100")
def first_queries(spark, folder):
    """The cap operator: the first 100 queries with a text, in order of their keys."""
    return table(spark, folder, "queries", "query_key", "query_id", "lang", "text").where("text IS NOT NULL").orderBy("query_key").limit(100).drop("text")


#: The categories that a benchmark should cover, and billions of parameters of backends whose size is known.
CATEGORIES = ("general", "legal", "business", "medical", "technical")
BILLIONS = {"openai": 200.0, "openai-4.1": 200.0, "paddleocr-vl": 0.9}


@query("untested_doc_types", f"SELECT DISTINCT strategy, category FROM (SELECT strategy FROM answers), (SELECT unnest({_list(CATEGORIES)}) AS category) EXCEPT SELECT strategy, lower(doc_type) FROM answers JOIN queries USING (query_id)")
def untested_doc_types(spark, folder):
    """For every strategy the categories that none of its answers covers: all less tested."""
    given = table(spark, folder, "answers", "query_id", "strategy")
    all_ = given.select("strategy").distinct().select("strategy", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    return all_.subtract(given.join(table(spark, folder, "queries", "query_id", "doc_type"), "query_id").select("strategy", F.lower("doc_type")))


_BY_BACKEND = (
    f"WITH {M._PAIRS.replace('SELECT page_id,', 'SELECT page_id, backend,', 1)}, nd AS (SELECT backend, pdf_path, {M._ned('pred', 'gt')} AS ned FROM pr WHERE rn > 1)"
)
_BILLIONS = "CASE backend " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in BILLIONS.items()) + " END"


def _parse_ned(spark, folder):
    return M.ned_pairs(spark, folder).join(table(spark, folder, "pages", "page_id", "backend"), "page_id")


@query("parse_averages", _BY_BACKEND + " SELECT backend, pdf_path, round(avg(ned) + 1e-9, 4) AS avg_ned, count(*) AS pages FROM nd GROUP BY ALL")
def parse_averages(spark, folder):
    """Mean NED of a backend's later parses of a document against the first parse of each page."""
    return _parse_ned(spark, folder).groupBy("backend", "pdf_path").agg(F.round(F.avg("ned") + F.lit(1e-9), 4).alias("avg_ned"), F.count("*").alias("pages"))


@query(
    "ned_per_parameter",
    _BY_BACKEND
    + f""", m AS (SELECT backend, round(avg(ned) + 1e-9, 4) AS ned, {_BILLIONS} AS billions FROM nd GROUP BY backend), e AS (SELECT *, round(ned / billions + 1e-9, 4) AS ned_per_billion FROM m)
SELECT *, CAST(row_number() OVER (ORDER BY ned_per_billion DESC NULLS LAST, backend) AS INTEGER) AS place FROM e""",
)
def ned_per_parameter(spark, folder):
    """NED for each billion parameters; backends of unknown size come last."""
    means = _parse_ned(spark, folder).groupBy("backend").agg(F.round(F.avg("ned") + F.lit(1e-9), 4).alias("ned"))
    size = F.create_map(*[F.lit(x) for pair in BILLIONS.items() for x in pair])[F.col("backend")]
    scored = means.withColumn("billions", size).withColumn("ned_per_billion", F.round(F.col("ned") / F.col("billions") + F.lit(1e-9), 4))
    # a row a backend
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("ned_per_billion"), "backend")))


@query(
    "class_leaders_differ",
    _SCORES
    + """, o AS (SELECT backend, round(avg(ned), 4) AS ned FROM sc WHERE ned IS NOT NULL GROUP BY backend), top AS (SELECT backend FROM o ORDER BY ned DESC, backend LIMIT 1),
m AS (SELECT doc_class, backend, round(avg(ned), 4) AS ned FROM sc WHERE ned IS NOT NULL GROUP BY ALL), l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_class ORDER BY ned DESC, backend) = 1)
SELECT l.doc_class, l.backend, l.ned, top.backend AS overall, m.ned AS overall_ned FROM l CROSS JOIN top LEFT JOIN m ON m.doc_class = l.doc_class AND m.backend = top.backend WHERE l.backend <> top.backend""",
)
def class_leaders_differ(spark, folder):
    """Classes of documents that another backend leads than the one that leads overall, with both means."""
    sums = S.score_sums(_scores(spark, folder)).groupBy("backend", "doc_class").agg(F.sum("ned").alias("s"), F.sum("neds").alias("n")).where("n > 0")
    order = Window.partitionBy("doc_class").orderBy(F.desc("ned"), "backend")
    # backends and classes are few
    all_ = sums.withColumn("overall_mean", F.round(F.sum("s").over(Window.partitionBy("backend")) / F.sum("n").over(Window.partitionBy("backend")), 4))
    led = all_.withColumn("overall", F.first("backend").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("overall_mean"), "backend"))).withColumn("ned", F.round(F.col("s") / F.col("n"), 4))
    of_leader = F.max(F.when(F.col("backend") == F.col("overall"), F.col("ned"))).over(Window.partitionBy("doc_class"))
    return led.select("doc_class", "backend", "ned", "overall", of_leader.alias("overall_ned"), F.row_number().over(order).alias("r")).where("r = 1 AND backend <> overall").drop("r")


@query(
    "quality_or_efficiency",
    _RAGAS
    + ", d AS (SELECT category, split_part(strategy, '+', 1) AS model, round(round(avg(composite), 10) + 1e-9, 6) AS composite FROM me GROUP BY ALL), e AS (SELECT *, CASE model "
    + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in S.PARAMETERS.items())
    + """ END AS params_m FROM d), f AS (SELECT *, round(composite / params_m * 1000, 6) AS efficiency FROM e WHERE params_m IS NOT NULL),
bq AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY category ORDER BY composite DESC, model) = 1), bw AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY category ORDER BY efficiency DESC, model) = 1)
SELECT category, bq.model AS best_quality, bw.model AS best_efficiency, bq.model = bw.model AS same, round(bq.params_m / bw.params_m, 4) AS size_ratio, bw.composite AS composite FROM bq JOIN bw USING (category)""",
)
def quality_or_efficiency(spark, folder):
    """The best local model of each category by quality and by quality for its size, and how many times larger the former is."""
    size = F.create_map(*[F.lit(x) for pair in S.PARAMETERS.items() for x in pair])
    models = _means(spark, folder).groupBy("category", F.get(F.split("strategy", r"\+"), F.lit(0)).alias("model")).agg(F.round(F.round(F.avg("composite"), 10) + F.lit(1e-9), 6).alias("composite"))
    scored = models.withColumn("params_m", size[F.col("model")]).where("params_m IS NOT NULL").withColumn("efficiency", F.round(F.col("composite") / F.col("params_m") * 1000, 6))
    best = lambda by: F.min_by(F.struct("model", "params_m", "composite"), F.struct(-F.col(by), F.col("model")))
    pairs = scored.groupBy("category").agg(best("composite").alias("q"), best("efficiency").alias("w"))
    return pairs.select("category", F.col("q.model").alias("best_quality"), F.col("w.model").alias("best_efficiency"), (F.col("q.model") == F.col("w.model")).alias("same"), F.round(F.col("q.params_m") / F.col("w.params_m"), 4).alias("size_ratio"), F.col("w.composite").alias("composite"))


_BOXES = "b AS (SELECT pdf_path, page_num, min(block_key) AS block_key, block_bbox[1] AS x0, block_bbox[2] AS y0, block_bbox[3] AS x1, block_bbox[4] AS y1 FROM blocks WHERE length(block_bbox) = 4 GROUP BY ALL)"


def _boxes(spark, folder):
    named = [F.col("block_bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    found = table(spark, folder, "blocks", "block_key", "pdf_path", "page_num", "block_bbox").where(F.size("block_bbox") == 4).select("pdf_path", "page_num", "block_key", *named)
    return found.groupBy("pdf_path", "page_num", "x0", "y0", "x1", "y1").agg(F.min("block_key").alias("block_key"))


@query(
    "bbox_overlaps",
    f"""WITH {_BOXES}, p AS (SELECT a.pdf_path, a.page_num, a.block_key, c.block_key AS other, (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (c.x1 - c.x0) * (c.y1 - c.y0) AS t
  FROM b a JOIN b c ON a.pdf_path = c.pdf_path AND a.page_num = c.page_num AND a.block_key < c.block_key AND least(a.x1, c.x1) > greatest(a.x0, c.x0) AND least(a.y1, c.y1) > greatest(a.y0, c.y0))
SELECT pdf_path, page_num, block_key, other, round(i / (s + t - i), 6) AS over_union, round(i / least(s, t), 6) AS over_small, round(i / greatest(s, t), 6) AS over_large FROM p""",
)
def bbox_overlaps(spark, folder):
    """Every pair of different boxes of a page that share an area; of equal boxes the smallest key stands for all."""
    return layout.overlapping(_boxes(spark, folder), ["pdf_path", "page_num"], "block_key")


@query("page_extents", f"WITH {_BOXES} SELECT pdf_path, page_num, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS boxes FROM b GROUP BY ALL")
def page_extents(spark, folder):
    """The box around everything on a page."""
    return layout.enclosing(_boxes(spark, folder), ["pdf_path", "page_num"])
