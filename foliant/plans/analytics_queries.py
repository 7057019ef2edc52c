"""Benchmark analytics over parsed pages, answers and latencies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import scoring as S
from foliant.operators.strategies import filled_answers
from foliant.plans.base import query
from foliant.plans.text_queries import NORMAL
from foliant.sources.tables import table

# Page scores: how much of a page its normal form keeps stands for text accuracy, the share of table lines for table accuracy.
_SCORES = (
    NORMAL.rstrip()
    + r""", sc AS (SELECT p.backend, p.pdf_path AS pdf, CASE WHEN contains(p.markdown, '|') THEN 'table' WHEN contains(p.markdown, '```') THEN 'graph' WHEN p.markdown IS NULL THEN 'unknown' ELSE 'text' END AS doc_class,
  CASE WHEN coalesce(metadata['dpi'], 'native') IN ('72', '150', '200') THEN metadata['dpi'] || 'dpi' ELSE 'native' END AS dpi,
  CASE WHEN length(p.markdown) > 0 THEN least(1.0, length(n.text) / length(p.markdown)) END AS ned,
  CASE WHEN contains(p.markdown, '|') THEN length(regexp_extract_all(p.markdown, '(?m)^\|')) / length(string_split(p.markdown, chr(10))) END AS teds,
  length(regexp_extract_all(p.markdown, '\S+')) AS words FROM pages p JOIN n USING (page_id))
"""
)
_AVG = """, av AS (SELECT backend, count(DISTINCT pdf) AS pdfs, round(avg(ned), 4) AS overall_ned, round(avg(CASE WHEN doc_class = 'text' THEN ned END), 4) AS text_ned, round(avg(CASE WHEN doc_class = 'table' THEN ned END), 4) AS table_ned,
  round(avg(CASE WHEN doc_class = 'graph' THEN ned END), 4) AS graph_ned, round(avg(CASE WHEN doc_class = 'table' THEN teds END), 4) AS table_teds, round(avg(teds), 4) AS overall_teds, round(avg(coalesce(words, 0)), 4) AS avg_words, CAST(sum(words) AS BIGINT) AS total_words
  FROM sc GROUP BY backend HAVING overall_ned IS NOT NULL)"""
_DPI = """, mm AS (SELECT backend, doc_class, dpi, round(avg(ned), 6) AS m FROM sc WHERE doc_class IN ('table', 'graph') GROUP BY ALL), sp AS (SELECT backend, doc_class, CASE WHEN count(m) >= 2 THEN max(m) - min(m) ELSE 0 END AS s FROM mm GROUP BY ALL),
ds AS (SELECT backend, round(coalesce(max(s), 0), 6) AS spread FROM (SELECT DISTINCT backend FROM sc) LEFT JOIN sp USING (backend) GROUP BY backend),
dd AS (SELECT backend, CAST(spread AS DOUBLE) AS spread, CASE WHEN spread <= 0.03 THEN 5 WHEN spread <= 0.05 THEN 4 WHEN spread <= 0.10 THEN 3 WHEN spread <= 0.20 THEN 2 ELSE 1 END AS dpi_score FROM ds)"""


def _attr(i):
    return "CASE backend " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in S.ATTRIBUTES.items()) + " ELSE 3 END"


_CARD = (
    _AVG
    + _DPI
    + f""", c1 AS (SELECT backend, overall_ned, CASE WHEN overall_ned >= 0.7 THEN 5 WHEN overall_ned >= 0.65 THEN 4 WHEN overall_ned >= 0.55 THEN 3 WHEN overall_ned >= 0.45 THEN 2 ELSE 1 END AS parsing_accuracy, {_attr(0)} AS data_security, {_attr(1)} AS cost_efficiency,
  CASE WHEN table_teds >= 0.6 THEN 5 WHEN table_teds >= 0.5 THEN 4 WHEN table_teds >= 0.35 THEN 3 WHEN table_teds >= 0.2 THEN 2 ELSE 1 END AS table_accuracy, dpi_score AS dpi_stability, {_attr(2)} AS ease_of_adoption FROM av JOIN dd USING (backend)),
c2 AS (SELECT *, round("""
    + " + ".join(f"round({k} * CAST({w} AS DOUBLE), 2)" for k, w in S.CRITERIA.items())
    + """, 2) AS total FROM c1), card AS (SELECT *, CAST(row_number() OVER (ORDER BY total DESC, overall_ned DESC NULLS LAST, backend) AS INTEGER) AS rank FROM c2)"""
)


def _scores(spark, folder):
    md = F.col("markdown")
    text = T.normalize_markdown(md)["text"]
    kind = F.when(md.contains("|"), "table").when(md.contains("```"), "graph").when(md.isNull(), "unknown").otherwise("text")
    dpi = F.col("metadata")["dpi"]
    return table(spark, folder, "pages", "backend", "pdf_path", "markdown", "metadata").select(
        "backend", F.col("pdf_path").alias("pdf"), kind.alias("doc_class"), F.when(dpi.isin("72", "150", "200"), F.concat(dpi, F.lit("dpi"))).otherwise("native").alias("dpi"),
        F.when(F.length(md) > 0, F.least(F.lit(1.0), F.length(text) / F.length(md))).alias("ned"),
        F.when(md.contains("|"), F.regexp_count(md, F.lit(r"(?md)^\|")) / F.size(F.split(md, "\n"))).alias("teds"), F.regexp_count(md, F.lit(r"\S+")).cast("long").alias("words"),
    )


@query("backend_averages", _SCORES + _AVG + " SELECT * FROM av")
def backend_averages(spark, folder):
    return S.backend_averages(_scores(spark, folder))


@query("dpi_stability", _SCORES + _DPI + " SELECT * FROM dd")
def dpi_stability(spark, folder):
    return S.dpi_stability(_scores(spark, folder))


@query("weighted_scorecard", _SCORES + _CARD + " SELECT backend, overall_ned, parsing_accuracy, data_security, cost_efficiency, table_accuracy, dpi_stability, ease_of_adoption, total, rank FROM card")
def weighted_scorecard(spark, folder):
    return S.weighted_scorecard(_scores(spark, folder))


@query(
    "backend_weaknesses",
    _SCORES
    + _CARD
    + ", g AS ("
    + " UNION ALL ".join(f"SELECT c.backend, '{k}' AS criterion, t.{k} - c.{k} AS points, round((t.{k} - c.{k}) * CAST({w} AS DOUBLE), 6) AS loss FROM card c JOIN card t ON t.rank = 1 AND c.rank > 1" for k, w in S.CRITERIA.items())
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY loss DESC, criterion) AS rn FROM g WHERE points > 0)
SELECT card.backend, coalesce(w, 'lower total') AS weakness FROM card LEFT JOIN (SELECT backend, string_agg(criterion || ' -' || points, ', ' ORDER BY rn) AS w FROM r WHERE rn <= 2 GROUP BY backend) USING (backend) WHERE card.rank > 1""",
)
def backend_weaknesses(spark, folder):
    return S.weaknesses(weighted_scorecard(spark, folder))


@query("doc_class_leaders", _SCORES + """, m AS (SELECT doc_class, backend, round(avg(ned), 4) AS ned FROM sc WHERE ned IS NOT NULL GROUP BY ALL) SELECT doc_class, backend, ned FROM m QUALIFY row_number() OVER (PARTITION BY doc_class ORDER BY ned DESC, backend) = 1""")
def doc_class_leaders(spark, folder):
    means = _scores(spark, folder).where("ned IS NOT NULL").groupBy("doc_class", "backend").agg(F.round(F.avg("ned"), 4).alias("ned"))
    best = F.row_number().over(Window.partitionBy("doc_class").orderBy(F.desc("ned"), "backend"))
    return means.withColumn("r", best).where("r = 1").drop("r")


@query("latest_parse", "SELECT page_id, backend, pdf_path, page_num, parsed_at FROM pages WHERE markdown IS NOT NULL QUALIFY row_number() OVER (PARTITION BY backend, pdf_path, page_num ORDER BY parsed_at DESC, page_id) = 1")
def latest_parse(spark, folder):
    newest = F.min_by(F.struct("page_id", "parsed_at"), F.struct(-F.unix_micros(F.col("parsed_at").cast("timestamp")), "page_id"))
    return table(spark, folder, "pages", "page_id", "backend", "pdf_path", "page_num", "parsed_at", "markdown").where("markdown IS NOT NULL").groupBy("backend", "pdf_path", "page_num").agg(newest.alias("s")).select("s.page_id", "backend", "pdf_path", "page_num", "s.parsed_at")


# Answer metrics: relevance of the citations, how many there are of three, the best of them, and length against 300 characters.
_RAGAS = """
WITH q AS (SELECT query_id, coalesce(doc_type, 'unknown') AS category FROM queries), rg AS (SELECT q.category, a.strategy, CASE WHEN length(citations) > 0 THEN list_max(list_transform(citations, lambda c: c.relevance_score)) END AS faithfulness,
  CASE WHEN length(answer) > 0 THEN least(1.0, length(answer) / 300.0) END AS answer_relevancy, list_avg(list_transform(citations, lambda c: c.relevance_score)) AS context_precision, CASE WHEN citations IS NOT NULL THEN least(1.0, length(citations) / 3.0) END AS context_recall FROM answers a JOIN q USING (query_id)),
mn AS (SELECT category, strategy, round(avg(context_recall), 4) AS context_recall, round(avg(context_precision), 4) AS context_precision, round(avg(faithfulness), 4) AS faithfulness, round(avg(answer_relevancy), 4) AS answer_relevancy, count(*) AS n FROM rg GROUP BY ALL),
me AS (SELECT *, round(round(0.35::DOUBLE * coalesce(context_recall, 0) + 0.3::DOUBLE * coalesce(context_precision, 0) + 0.2::DOUBLE * coalesce(faithfulness, 0) + 0.15::DOUBLE * coalesce(answer_relevancy, 0), 6) + 1e-9, 4) AS composite FROM mn)
"""
_VALID = "latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0"


def _ragas(spark, folder):
    category = table(spark, folder, "queries", "query_id", "doc_type").select("query_id", F.coalesce("doc_type", F.lit("unknown")).alias("category"))
    scores = F.filter(F.transform("citations", lambda c: c["relevance_score"]), lambda x: x.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
    return table(spark, folder, "answers", "query_id", "strategy", "answer", "citations").join(category, "query_id").select(
        "category", "strategy", F.array_max(scores).alias("faithfulness"), F.when(F.length("answer") > 0, F.least(F.lit(1.0), F.length("answer") / 300.0)).alias("answer_relevancy"), mean.alias("context_precision"),
        F.when(F.col("citations").isNotNull(), F.least(F.lit(1.0), F.size("citations") / 3.0)).alias("context_recall"),
    )


def _means(spark, folder):
    return S.strategy_means(_ragas(spark, folder))


@query("strategy_means", _RAGAS + "SELECT category, strategy, context_recall, context_precision, faithfulness, answer_relevancy, n, composite FROM me")
def strategy_means(spark, folder):
    return _means(spark, folder)


_RANKED = f""", lt AS (SELECT strategy, round(avg(latency_ms), 4) AS avg_latency, round(median(latency_ms), 4) AS median_latency FROM latency WHERE {_VALID} GROUP BY strategy),
rk AS (SELECT category, strategy, composite, avg_latency, median_latency, CAST(row_number() OVER (PARTITION BY category ORDER BY composite DESC, strategy) AS INTEGER) AS rank,
  CASE WHEN max(composite) OVER (PARTITION BY category) > 0 THEN round((max(composite) OVER (PARTITION BY category) - composite) / max(composite) OVER (PARTITION BY category) * 100, 4) ELSE 0 END AS gap_pct FROM me LEFT JOIN lt USING (strategy))"""


def _ranked(spark, folder):
    return S.rank_combos(_means(spark, folder), table(spark, folder, "latency", "strategy", "latency_ms"))


@query("rank_combos", _RAGAS + _RANKED + " SELECT * FROM rk")
def rank_combos(spark, folder):
    return _ranked(spark, folder)


@query("category_head", _RAGAS + _RANKED + " SELECT category, strategy, rank, composite FROM rk WHERE rank <= 3")
def category_head(spark, folder):
    """The report's top three of each category."""
    return _ranked(spark, folder).where("rank <= 3").select("category", "strategy", "rank", "composite")


@query("top_gap", _RAGAS + _RANKED + " SELECT a.category, a.strategy AS first, b.strategy AS second, round(a.composite - b.composite, 4) AS gap, a.composite - b.composite < 0.02 AS negligible FROM rk a JOIN rk b ON a.category = b.category AND a.rank = 1 AND b.rank = 2")
def top_gap(spark, folder):
    w = Window.partitionBy("category").orderBy("rank")
    pairs = _ranked(spark, folder).select("category", "strategy", "composite", "rank", F.lead("strategy").over(w).alias("second"), F.lead("composite").over(w).alias("next"))
    gap = F.col("composite") - F.col("next")
    return pairs.where("rank = 1 AND second IS NOT NULL").select("category", F.col("strategy").alias("first"), "second", F.round(gap, 4).alias("gap"), (gap < 0.02).alias("negligible"))


@query(
    "strategy_strengths",
    _RAGAS
    + """SELECT category, strategy, coalesce(nullif(array_to_string(list_filter([CASE WHEN abs(faithfulness - max(faithfulness) OVER w) < 1e-6 THEN 'faithfulness' END, CASE WHEN abs(context_recall - max(context_recall) OVER w) < 1e-6 THEN 'recall' END,
  CASE WHEN abs(context_precision - max(context_precision) OVER w) < 1e-6 THEN 'precision' END, CASE WHEN abs(answer_relevancy - max(answer_relevancy) OVER w) < 1e-6 THEN 'relevancy' END], lambda x: x IS NOT NULL)[1:2], ', '), ''), 'balanced') AS strengths FROM me WINDOW w AS (PARTITION BY category)""",
)
def strategy_strengths(spark, folder):
    w = Window.partitionBy("category")
    best = lambda c, name: F.when(F.abs(F.col(c) - F.max(c).over(w)) < 1e-6, name)
    found = F.array(best("faithfulness", "faithfulness"), best("context_recall", "recall"), best("context_precision", "precision"), best("answer_relevancy", "relevancy"))
    df = _means(spark, folder).select("category", "strategy", found.alias("f"))
    text = F.array_join(F.slice(F.filter("f", lambda x: x.isNotNull()), 1, 2), ", ")
    return df.select("category", "strategy", F.when(text == "", "balanced").otherwise(text).alias("strengths"))


@query(
    "rank_strategies_profiles",
    _RAGAS
    + ", pf AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{p}', '{m}', CAST({w} AS DOUBLE))" for p, ws in S.PROFILES.items() for m, w in ws.items())
    + """) t(profile, metric, weight)), ms AS (SELECT strategy, round(avg(faithfulness), 4) AS faithfulness, round(avg(answer_relevancy), 4) AS answer_relevancy, round(avg(context_precision), 4) AS context_precision, round(avg(context_recall), 4) AS context_recall FROM rg GROUP BY strategy),
u AS (UNPIVOT ms ON faithfulness, answer_relevancy, context_precision, context_recall INTO NAME metric VALUE v),
t AS (SELECT s.strategy, p.profile, round(round(coalesce(sum(weight * v), 0), 6) + 1e-9, 4) AS score FROM (SELECT strategy FROM ms) s CROSS JOIN (SELECT DISTINCT profile FROM pf) p LEFT JOIN (SELECT strategy, profile, weight, v FROM u JOIN pf USING (metric)) x ON x.strategy = s.strategy AND x.profile = p.profile GROUP BY ALL)
SELECT profile, strategy, score, CAST(row_number() OVER (PARTITION BY profile ORDER BY score DESC, strategy) AS INTEGER) AS rank FROM t""",
)
def rank_strategies_profiles(spark, folder):
    """Profile scores: a metric that wasn't measured contributes nothing."""
    metrics = ["faithfulness", "answer_relevancy", "context_precision", "context_recall"]
    means = _ragas(spark, folder).groupBy("strategy").agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics])
    scored = [F.struct(F.lit(p).alias("profile"), S.half_up(sum((F.coalesce(F.col(m), F.lit(0.0)) * w for m, w in ws.items() if m in metrics), F.lit(0.0))).alias("score")) for p, ws in S.PROFILES.items()]
    return means.select("strategy", F.inline(F.array(*scored))).select("profile", "strategy", "score", F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("score"), "strategy")).alias("rank"))


_API = "(contains(lower(strategy), 'openai') OR contains(lower(strategy), 'upstage'))"


@query("best_local_api", _RAGAS + f"SELECT category, {_API} AS api, arg_max(strategy, (composite, strategy)) AS strategy, max(composite) AS composite FROM me GROUP BY ALL")
def best_local_api(spark, folder):
    return _means(spark, folder).groupBy("category", S.is_api(F.col("strategy")).alias("api")).agg(F.max_by("strategy", F.struct("composite", "strategy")).alias("strategy"), F.max("composite").alias("composite"))


@query(
    "recommendations",
    _RAGAS
    + f"""SELECT category, 'overall' AS purpose, arg_max(strategy, (composite, strategy)) AS strategy FROM me GROUP BY category UNION ALL SELECT category, 'recall', arg_max(strategy, (coalesce(context_recall, -1), strategy)) FROM me GROUP BY category
UNION ALL SELECT category, 'faithfulness', arg_max(strategy, (coalesce(faithfulness, -1), strategy)) FROM me GROUP BY category
UNION ALL SELECT category, 'local', l FROM (SELECT category, arg_max(strategy, (composite, strategy)) AS strategy, arg_max(strategy, (composite, strategy)) FILTER (NOT {_API}) AS l FROM me GROUP BY category) WHERE {_API} AND l IS NOT NULL""",
)
def recommendations(spark, folder):
    by = lambda c: F.max_by("strategy", F.struct(F.coalesce(F.col(c), F.lit(-1.0)), "strategy"))
    local = F.max_by(F.when(~S.is_api(F.col("strategy")), F.col("strategy")), F.when(~S.is_api(F.col("strategy")), F.struct("composite", "strategy")))
    best = _means(spark, folder).groupBy("category").agg(by("composite").alias("overall"), by("context_recall").alias("recall"), by("faithfulness").alias("faithfulness"), local.alias("local"))
    best = best.withColumn("local", F.when(S.is_api(F.col("overall")), F.col("local")))
    return best.unpivot(["category"], ["overall", "recall", "faithfulness", "local"], "purpose", "strategy").where("strategy IS NOT NULL")


_LAYERS = ("dense", "sparse", "reranker", "support")


@query(
    "layer_marginals",
    _RAGAS
    + ", l AS (SELECT *, "
    + ", ".join(f"split_part(strategy, '+', {i + 1}) AS {n}" for i, n in enumerate(_LAYERS))
    + " FROM me) "
    + " UNION ALL ".join(f"SELECT '{n}' AS layer, {n} AS value, round(avg(composite), 4) AS composite, CAST(sum(n) AS BIGINT) AS answers, count(*) AS combos FROM l GROUP BY {n}" for n in _LAYERS),
)
def layer_marginals(spark, folder):
    """One pass over four grouping sets."""
    parts = F.split("strategy", r"\+")
    layered = _means(spark, folder).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(_LAYERS)], "composite", "n")
    sets = layered.groupingSets([[n] for n in _LAYERS], *_LAYERS).agg(F.round(F.avg("composite"), 4).alias("composite"), F.sum("n").alias("answers"), F.count("*").alias("combos"), F.grouping_id().alias("g"))
    layer = F.when(F.col("g") == 7, "dense").when(F.col("g") == 11, "sparse").when(F.col("g") == 13, "reranker").otherwise("support")
    return sets.select(layer.alias("layer"), F.coalesce(*_LAYERS).alias("value"), "composite", "answers", "combos")


@query("model_comparison", _RAGAS + "SELECT category, split_part(strategy, '+', 1) AS model, " + ", ".join(f"round(round(avg({c}), 8) + 1e-9, 4) AS {n}" for c, n in (("composite", "composite"), ("context_recall", "recall"), ("faithfulness", "faithfulness"))) + ", count(*) AS combos FROM me GROUP BY ALL")
def model_comparison(spark, folder):
    mean = lambda c: F.round(F.round(F.avg(c), 8) + F.lit(1e-9), 4)
    return _means(spark, folder).groupBy("category", F.get(F.split("strategy", r"\+"), F.lit(0)).alias("model")).agg(
        mean("composite").alias("composite"), mean("context_recall").alias("recall"), mean("faithfulness").alias("faithfulness"), F.count("*").alias("combos")
    )


@query(
    "param_efficiency",
    _RAGAS
    + ", d AS (SELECT split_part(strategy, '+', 1) AS model, round(avg(composite), 6) AS composite FROM me GROUP BY ALL), e AS (SELECT model, composite, CASE model "
    + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in S.PARAMETERS.items())
    + " END AS params_m FROM d), f AS (SELECT *, round(composite / params_m * 1000, 6) AS efficiency FROM e WHERE params_m IS NOT NULL) SELECT *, round(efficiency / max(efficiency) OVER (), 6) AS of_best FROM f",
)
def param_efficiency(spark, folder):
    return S.parameter_efficiency(_means(spark, folder))


@query(
    "metric_spread",
    _RAGAS
    + ", u AS (UNPIVOT (SELECT category, strategy, faithfulness, answer_relevancy, context_precision, context_recall FROM me) ON faithfulness, answer_relevancy, context_precision, context_recall INTO NAME metric VALUE v) SELECT category, metric, max(v) AS best, min(v) AS worst, round(max(v) - min(v), 4) AS spread, CASE WHEN max(v) > 0 THEN round((max(v) - min(v)) / max(v) * 100, 4) ELSE 0 END AS spread_pct, max(v) > 0 AND (max(v) - min(v)) / nullif(max(v), 0) > 0.05 AS wide FROM u GROUP BY ALL",
)
def metric_spread(spark, folder):
    long = _means(spark, folder).unpivot(["category"], ["faithfulness", "answer_relevancy", "context_precision", "context_recall"], "metric", "v").where("v IS NOT NULL")
    best, worst = F.max("v"), F.min("v")
    share = F.when(best > 0, (best - worst) / best).otherwise(F.lit(0.0))
    return long.groupBy("category", "metric").agg(best.alias("best"), worst.alias("worst"), F.round(best - worst, 4).alias("spread"), F.round(share * 100, 4).alias("spread_pct"), (share > 0.05).alias("wide"))


@query(
    "display_names",
    "SELECT DISTINCT strategy, concat_ws(' + ', "
    + ", ".join("CASE " + " ".join(f"WHEN contains(lower(strategy), '{k}') THEN '{v}'" for k, v in names) + " END" for names in S.DISPLAY)
    + f") AS name, {_API} AS api, replace(lower(strategy), '+', '-') AS label, split_part(strategy, '+', 1) || ':' || split_part(strategy, '+', 2) AS index_key FROM latency",
)
def display_names(spark, folder):
    s = F.col("strategy")
    parts = F.split(s, r"\+")
    return table(spark, folder, "latency", "strategy").distinct().select("strategy", S.display_name(s).alias("name"), S.is_api(s).alias("api"), F.replace(F.lower(s), F.lit("+"), F.lit("-")).alias("label"), F.concat(F.get(parts, F.lit(0)), F.lit(":"), F.get(parts, F.lit(1))).alias("index_key"))


@query("cover_totals", _RAGAS + "SELECT count(DISTINCT category) AS categories, CAST(sum(n) AS BIGINT) AS answers, count(DISTINCT strategy) AS strategies, array_to_string(list_sort(list(DISTINCT split_part(strategy, '+', 3))), ',') AS rerankers FROM me")
def cover_totals(spark, folder):
    return _means(spark, folder).agg(F.count_distinct("category").alias("categories"), F.sum("n").alias("answers"), F.count_distinct("strategy").alias("strategies"), F.array_join(F.array_sort(F.collect_set(F.get(F.split("strategy", r"\+"), F.lit(2)))), ",").alias("rerankers"))


_GRID = "WITH g AS (SELECT DISTINCT split_part(strategy, '+', 1) AS a, split_part(strategy, '+', 2) AS b, split_part(strategy, '+', 3) AS c, split_part(strategy, '+', 4) AS d FROM latency), e AS (SELECT w.a || '+' || x.b || '+' || y.c || '+' || z.d AS strategy FROM (SELECT DISTINCT a FROM g) w, (SELECT DISTINCT b FROM g) x, (SELECT DISTINCT c FROM g) y, (SELECT DISTINCT d FROM g) z)"


def _grid(spark, folder):
    """Every combination of the layers' values that occur; the sets of values are small."""
    parts = F.split("strategy", r"\+")
    sets = table(spark, folder, "latency", "strategy").distinct().agg(*[F.collect_set(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(_LAYERS)])
    for n in _LAYERS:
        sets = sets.withColumn(n, F.explode(n))
    return sets.where(" AND ".join(f"{n} <> ''" for n in _LAYERS)).select(F.concat_ws("+", *_LAYERS).alias("strategy"))


@query("combo_grid", _GRID + " SELECT strategy, replace(lower(strategy), '+', '-') AS label FROM e")
def combo_grid(spark, folder):
    return _grid(spark, folder).select("strategy", F.replace(F.lower("strategy"), F.lit("+"), F.lit("-")).alias("label"))


@query("combo_completeness", _GRID + ", f AS (SELECT DISTINCT coalesce(doc_type, 'unknown') AS category, strategy FROM answers JOIN queries USING (query_id)), k AS (SELECT DISTINCT category FROM f) SELECT k.category, e.strategy FROM k CROSS JOIN e ANTI JOIN f ON f.category = k.category AND f.strategy = e.strategy")
def combo_completeness(spark, folder):
    """Combinations without a single answer, by category; categories are few."""
    found = _ragas(spark, folder).select("category", "strategy").distinct()
    categories = found.agg(F.collect_set("category").alias("cs"))
    expected = _grid(spark, folder).select("strategy", F.explode(categories.scalar()).alias("category"))
    return expected.join(found, ["category", "strategy"], "left_anti")


@query("untested_categories", "SELECT DISTINCT strategy, category FROM (SELECT strategy FROM latency), (SELECT DISTINCT category FROM latency WHERE category IS NOT NULL) EXCEPT SELECT DISTINCT strategy, category FROM latency WHERE error IS NULL AND latency_ms > 50000")
def untested_categories(spark, folder):
    """Categories in which a strategy never took more than 50 s without an error: all less those tested so hard."""
    lat = table(spark, folder, "latency", "strategy", "category", "error", "latency_ms")
    categories = lat.where("category IS NOT NULL").agg(F.collect_set("category").alias("cs"))
    all_ = lat.select("strategy").distinct().select("strategy", F.explode(categories.scalar()).alias("category"))
    return all_.subtract(lat.where("error IS NULL AND latency_ms > 50000").select("strategy", "category"))


@query(
    "latency_summary",
    f"""WITH v AS (SELECT strategy, latency_ms, row_number() OVER (PARTITION BY strategy ORDER BY latency_ms) - 1 AS pos, count(*) OVER (PARTITION BY strategy) AS n FROM latency WHERE {_VALID})
SELECT strategy, count(*) AS queries, round(avg(latency_ms), 1) AS avg_ms, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, max(CASE WHEN pos = n // 2 THEN latency_ms END) AS p50, max(CASE WHEN pos = n * 95 // 100 THEN latency_ms END) AS p95 FROM v GROUP BY strategy""",
)
def latency_summary(spark, folder):
    return S.latency_summary(table(spark, folder, "latency", "strategy", "latency_ms"))


@query("run_compare", f"SELECT strategy, count(*) AS runs, count(*) FILTER (error IS NOT NULL) AS errors, round(avg(CASE WHEN error IS NULL AND {_VALID} THEN latency_ms END), 4) AS avg_latency, round(avg(CASE WHEN error IS NULL THEN num_results END), 4) AS avg_results FROM latency GROUP BY strategy")
def run_compare(spark, folder):
    lat = table(spark, folder, "latency", "strategy", "latency_ms", "num_results", "error")
    fine = F.col("error").isNull()
    valid = fine & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.col("latency_ms") >= 0)
    return lat.groupBy("strategy").agg(F.count("*").alias("runs"), F.count("error").alias("errors"), F.round(F.avg(F.when(valid, F.col("latency_ms"))), 4).alias("avg_latency"), F.round(F.avg(F.when(fine, F.col("num_results"))), 4).alias("avg_results"))


@query(
    "qa_scaling",
    f"""WITH s AS (SELECT count(DISTINCT query_id) AS cur, avg(latency_ms) / 1000 AS rate, count(DISTINCT strategy) AS k FROM latency WHERE {_VALID}), c AS (SELECT DISTINCT unnest([5, 10, 20, 50, 100, 200, cur]) AS n, rate, k FROM s)
SELECT CAST(n AS BIGINT) AS n, round(n * rate, 4) AS retrieve_s, round(n * rate * k, 4) AS all_strategies_s FROM c""",
)
def qa_scaling(spark, folder):
    lat = table(spark, folder, "latency", "query_id", "strategy", "latency_ms").where(F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.col("latency_ms") >= 0))
    one = lat.agg(F.count_distinct("query_id").alias("cur"), (F.avg("latency_ms") / 1000).alias("rate"), F.count_distinct("strategy").alias("k"))
    sizes = F.array_union(F.array(*[F.lit(n).cast("long") for n in (5, 10, 20, 50, 100, 200)]), F.array("cur"))
    return one.select(F.explode(sizes).alias("n"), "rate", "k").select("n", F.round(F.col("n") * F.col("rate"), 4).alias("retrieve_s"), F.round(F.col("n") * F.col("rate") * F.col("k"), 4).alias("all_strategies_s"))


@query("run_totals", f"SELECT CAST(run_at AS DATE) AS day, count(*) FILTER (error IS NULL) AS succeeded, count(*) FILTER (error IS NOT NULL) AS failed, round(sum(CASE WHEN error IS NULL AND {_VALID} THEN latency_ms ELSE 0 END) / 1000, 4) AS seconds FROM latency GROUP BY ALL")
def run_totals(spark, folder):
    lat = table(spark, folder, "latency", "run_at", "error", "latency_ms")
    fine = F.col("error").isNull() & F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.col("latency_ms") >= 0)
    return lat.groupBy(F.to_date("run_at").alias("day")).agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count("error").alias("failed"), F.round(F.sum(F.when(fine, F.col("latency_ms")).otherwise(0.0)) / 1000, 4).alias("seconds"))


@query("token_rollup", "SELECT coalesce(strategy, 'total') AS strategy, coalesce(backend, 'total') AS backend, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS calls FROM (SELECT strategy, CASE WHEN contains(strategy, 'contextual') THEN 'contextual' ELSE 'plain' END AS backend, coalesce(length(answer), 0) AS tokens FROM answers) GROUP BY ROLLUP (strategy, backend)")
def token_rollup(spark, folder):
    rows = table(spark, folder, "answers", "strategy", "answer").select("strategy", F.when(F.contains("strategy", F.lit("contextual")), "contextual").otherwise("plain").alias("backend"), F.coalesce(F.length("answer"), F.lit(0)).alias("tokens"))
    return rows.rollup("strategy", "backend").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls")).select(F.coalesce("strategy", F.lit("total")).alias("strategy"), F.coalesce("backend", F.lit("total")).alias("backend"), "tokens", "calls")


@query("phase_share", "WITH p AS (SELECT event_type AS phase, user_id AS run_id, round(sum(value), 4) AS s FROM events GROUP BY ALL) SELECT run_id, phase, s AS seconds, round(s / sum(s) OVER (PARTITION BY run_id) * 100, 4) AS pct FROM p WHERE s > 0")
def phase_share(spark, folder):
    phases = table(spark, folder, "events", "event_type", "user_id", "value").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase")).agg(F.round(F.sum("value"), 4).alias("seconds")).where("seconds > 0")
    return phases.select("run_id", "phase", "seconds", F.round(F.col("seconds") / F.sum("seconds").over(Window.partitionBy("run_id")) * 100, 4).alias("pct"))


@query("spec_grid", "WITH d AS (SELECT DISTINCT pdf_path FROM pages), b AS (SELECT DISTINCT backend FROM pages), t AS (SELECT pdf_path, count(*) AS pages FROM pages GROUP BY ALL) SELECT backend, pdf_path, substring(replace(backend || '-' || regexp_extract(pdf_path, '([^/]+)\\.pdf$', 1) || '-direct', '_', '-'), 1, 63) AS label, pages FROM d CROSS JOIN b LEFT JOIN t USING (pdf_path)")
def spec_grid(spark, folder):
    """Backends by documents with the derived label; backends are few and come from one set."""
    pages = table(spark, folder, "pages", "backend", "pdf_path")
    backends = pages.agg(F.collect_set("backend").alias("bs"))
    grid = pages.groupBy("pdf_path").agg(F.count("*").alias("pages")).select("pdf_path", "pages", F.explode(backends.scalar()).alias("backend"))
    label = F.substring(F.replace(F.concat("backend", F.lit("-"), F.regexp_extract("pdf_path", r"([^/]+)\.pdf$", 1), F.lit("-direct")), F.lit("_"), F.lit("-")), 1, 63)
    return grid.select("backend", "pdf_path", label.alias("label"), "pages")


@query("document_averages", _SCORES + " SELECT backend, pdf, round(avg(ned), 4) AS avg_ned, round(avg(teds), 4) AS avg_teds, round(avg(coalesce(words, 0)), 2) AS avg_words, CAST(sum(coalesce(words, 0)) AS BIGINT) AS total_words, count(*) AS pages FROM sc GROUP BY ALL")
def document_averages(spark, folder):
    """Page scores by document; pages without a score don't count in the mean, a document without any has none."""
    words = F.coalesce("words", F.lit(0))
    return _scores(spark, folder).groupBy("backend", "pdf").agg(F.round(F.avg("ned"), 4).alias("avg_ned"), F.round(F.avg("teds"), 4).alias("avg_teds"), F.round(F.avg(words), 2).alias("avg_words"), F.sum(words).alias("total_words"), F.count("*").alias("pages"))


@query("qa_counts", "WITH c AS (SELECT coalesce(doc_type, 'unknown') AS category, strategy, count(DISTINCT query_id) AS n FROM answers JOIN queries USING (query_id) GROUP BY ALL) SELECT category, max(n) AS n_qa, count(*) AS strategies FROM c GROUP BY category")
def qa_counts(spark, folder):
    """Questions of each category: the most that any strategy answered."""
    category = table(spark, folder, "queries", "query_id", "doc_type").select("query_id", F.coalesce("doc_type", F.lit("unknown")).alias("category"))
    per = table(spark, folder, "answers", "query_id", "strategy").join(category, "query_id").groupBy("category", "strategy").agg(F.count_distinct("query_id").alias("n"))
    return per.groupBy("category").agg(F.max("n").alias("n_qa"), F.count("*").alias("strategies"))


@query("fallback_fields", "SELECT answer_id, coalesce(nullif(answer, ''), CASE WHEN length(citations) > 0 THEN citations[1].text_snippet END, 'No answer was generated.') AS answer, answer IS NULL OR answer = '' AS filled FROM answers")
def fallback_fields(spark, folder):
    """Missing answers take the first citation's text, else a constant; given ones stay."""
    rows = table(spark, folder, "answers", "answer_id", "answer", "citations")
    given = F.coalesce("answer", F.lit("")) == ""
    return filled_answers(rows.withColumn("filled", given), F.get("citations", 0)["text_snippet"]).select("answer_id", "answer", "filled")


@query("injected_results", "SELECT strategy, count(*) AS runs FROM latency SEMI JOIN (SELECT DISTINCT strategy FROM answers) USING (strategy) GROUP BY strategy")
def injected_results(spark, folder):
    """Results of known strategies only."""
    known = table(spark, folder, "answers", "strategy").distinct()
    return table(spark, folder, "latency", "strategy").join(known, "strategy", "left_semi").groupBy("strategy").agg(F.count("*").alias("runs"))
