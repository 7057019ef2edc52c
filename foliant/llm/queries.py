"""pN_ queries: each applies one operator, with production parameters, to its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.llm import abuse, cuts, encoding, lookalikes, packing, pairs, percentiles, scans, splitting
from foliant.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable(spark, folder) and, where there is one, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p7_ids")
def p7_ids(spark, folder):
    return encoding.encode_documents(table(spark, folder, "documents", "doc_id", "text"))


@query("p7_round_trip")
def p7_round_trip(spark, folder):
    return encoding.round_trip(table(spark, folder, "documents", "doc_id", "text"))


@query("p8_containers")
def p8_containers(spark, folder):
    return packing.pack(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "pack_limits"))


@query("p8_fill")
def p8_fill(spark, folder):
    return packing.fill_report(p8_containers(spark, folder), table(spark, folder, "pack_limits"))


_LATENCIES = """
WITH once AS (
  SELECT DISTINCT lat_id, strategy, CAST(run_at AS DATE) AS day, latency_ms FROM latency
  WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms) AND latency_ms >= 0
), scoped AS (
  SELECT 'day' AS scope, strategy, day, latency_ms FROM once
  UNION ALL SELECT 'all', strategy, CAST(NULL AS DATE), latency_ms FROM once
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY scope, strategy, day ORDER BY latency_ms) AS rank, count(*) OVER (PARTITION BY scope, strategy, day) AS n FROM scoped
), targets AS (SELECT unnest([10, 50, 250, 500, 750, 900, 950, 990, 999]) AS t),
hit AS (SELECT scope, strategy, day, t, n, latency_ms, CAST(ceil(ln(latency_ms) / ln(1.005 / 0.995)) AS INTEGER) AS b FROM ranked JOIN targets ON rank = (n * t + 999) // 1000)
"""


@query(
    "p3_percentiles",
    _LATENCIES
    + """SELECT scope, strategy, day, t / 1000 AS p, n,
  round(2 * pow(1.005 / 0.995, b) / (1.005 / 0.995 + 1), 6) AS value, round(pow(1.005 / 0.995, b - 1), 6) AS low,
  round(pow(1.005 / 0.995, b), 6) AS high, CAST(0.005 AS DOUBLE) AS error FROM hit""",
)
def p3_percentiles(spark, folder):
    return percentiles.latency_percentiles(table(spark, folder, "latency", "lat_id", "strategy", "run_at", "latency_ms"))


@query(
    "p3_exact_percentiles",
    _LATENCIES + "SELECT scope, strategy, day, t / 1000 AS p, n, latency_ms AS value, latency_ms AS low, latency_ms AS high, CAST(0 AS DOUBLE) AS error FROM hit",
)
def p3_exact_percentiles(spark, folder):
    return percentiles.latency_percentiles(table(spark, folder, "latency", "lat_id", "strategy", "run_at", "latency_ms"), error=0.0)


@query("p2_found")
def p2_found(spark, folder):
    pages = lookalikes.lookalike_pairs(table(spark, folder, "pages", "page_id", "markdown"), "page_id", "markdown")
    corpus = lookalikes.lookalike_pairs(table(spark, folder, "corpus", "corpus_key", "text"), "corpus_key", "text")
    return pages.select(F.lit("pages").alias("src"), "id_a", "id_b").unionByName(corpus.select(F.lit("corpus").alias("src"), "id_a", "id_b"))


@query("p2_normalized")
def p2_normalized(spark, folder):
    pages = lookalikes.normalize_texts(table(spark, folder, "pages", "page_id", "markdown"), "page_id", "markdown")
    corpus = lookalikes.normalize_texts(table(spark, folder, "corpus", "corpus_key", "text"), "corpus_key", "text")
    return pages.selectExpr("'pages' AS src", "page_id AS row_id", "markdown AS text", "changed").unionByName(
        corpus.selectExpr("'corpus' AS src", "corpus_key AS row_id", "text", "changed")
    )


@query("p1_chunks")
def p1_chunks(spark, folder):
    return splitting.split_texts(table(spark, folder, "pages", "page_id", "markdown", "config_id"), table(spark, folder, "chunk_configs"))


@query(
    "p1_found",
    r"""
SELECT page_id, CASE WHEN list_max(list_transform(regexp_split_to_array(markdown, '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}。]'), lambda x: length(x))) > chunk_size
  THEN 'forced' ELSE 'boundary' END AS cut
FROM pages JOIN chunk_configs USING (config_id) WHERE length(markdown) > chunk_size""",
)
def p1_found(spark, folder):
    firsts = p1_chunks(spark, folder).where("over and piece = 0")
    return firsts.select("page_id", F.when(F.col("stretch") > F.col("size"), "forced").otherwise("boundary").alias("cut"))


@query("p6_defects")
def p6_defects(spark, folder):
    return pairs.defects(table(spark, folder, "answers", "answer_id", "query_id", "answer"), table(spark, folder, "queries", "query_id", "text"))


@query("p6_found")
def p6_found(spark, folder):
    return p6_defects(spark, folder).where("found is not null").select("answer_id", F.col("found").alias("defect"))


@query("p9_found")
def p9_found(spark, folder):
    return p9_scores(spark, folder).where(F.col("score") >= abuse.CUTOFF).select("doc_id")


@query("p9_scores")
def p9_scores(spark, folder):
    return abuse.scores(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "doc_labels", "doc_id", "abuse"))


@query("p9_source_rates")
def p9_source_rates(spark, folder):
    documents, labels = table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "doc_labels", "doc_id", "abuse")
    return abuse.source_rates(abuse.scores(documents, labels, keep=("source",)))


def _scanned(spark, folder):
    return table(spark, folder, "pages", "page_id", "pdf_path", "page_num", "markdown"), table(spark, folder, "blocks", "block_key", "pdf_path", "page_num", "block_content")


@query("p4_found")
def p4_found(spark, folder):
    return scans.noise(*_scanned(spark, folder))


@query("p4_repaired")
def p4_repaired(spark, folder):
    return scans.repaired(*_scanned(spark, folder))


def _stored(spark, folder):
    pages = table(spark, folder, "pages", "page_id", "pdf_path", "page_num", "backend", "markdown")
    return pages, table(spark, folder, "blocks", "block_key", "pdf_path", "page_num", "block_order", "block_label", "block_content", "backend")


@query("p5_found")
def p5_found(spark, folder):
    return cuts.judged(*_stored(spark, folder)).where("cut").select("src", "row_id")


@query("p5_rates")
def p5_rates(spark, folder):
    return cuts.cut_rates(cuts.judged(*_stored(spark, folder)))
