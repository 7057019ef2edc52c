"""Queries through what is stored: indexes, runs, sets, prefix caches and workers' output."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import chunking, ngrams, retrieval, strategies
from foliant.plans import metric_queries as M
from foliant.plans.base import SQL, query
from foliant.plans.retrieval_queries import K, _STATS, _TOP, _corpus, _queries
from foliant.session import new_folder
from foliant.sources import readers
from foliant.sources.tables import table


@query("stored_bm25_topk", SQL["bm25_topk"])
def stored_bm25_topk(spark, folder):
    """Search of an index that is built for its (dense, sparse) pair, stored and read again."""
    cache = retrieval.IndexCache(spark, new_folder(spark, "indexes"))
    cache.get_or_build("bge-m3", "korean_bm25", _corpus(spark, folder))
    return cache.get_or_build("bge-m3", "korean_bm25", _corpus(spark, folder)).search(_queries(spark, folder), K).select("query_id", "corpus_key", "score", "rank")


@query(
    "benchmark_run",
    _STATS
    + _TOP.format("wr", 5)
    + ", s2 AS (SELECT query_id, corpus_key, round(sum(wq * wd), 6) AS score FROM ws JOIN wd USING (term) GROUP BY ALL), top2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_key) AS rank FROM s2 QUALIFY rank <= 5)"
    + """, r AS (SELECT 'reference' AS strategy, query_id, count(*) AS n FROM top GROUP BY ALL UNION ALL SELECT 'standard', query_id, count(*) FROM top2 GROUP BY ALL), q AS (SELECT query_id, unnest(['reference', 'standard']) AS strategy FROM queries)
SELECT strategy, query_id, CAST(coalesce(n, 0) AS INTEGER) AS num_results, CAST(NULL AS VARCHAR) AS error FROM q LEFT JOIN r USING (strategy, query_id)""",
)
def benchmark_run(spark, folder):
    """Two strategies over all queries in one plan; a query without a hit has none, an error would stand beside it."""
    chunks = _corpus(spark, folder).select(F.col("corpus_key").alias("chunk_key"), "content")
    both = [strategies.SparseStrategy("reference"), strategies.SparseStrategy("standard", "standard")]
    index = retrieval.bm25_index(chunks.withColumnRenamed("chunk_key", "corpus_key"))
    for s in both:
        s.stored = index
    return strategies.run(both, _queries(spark, folder), 5).select("strategy", "query_id", "num_results", "error")


@query("latest_run", "SELECT strategy, count(*) AS rows, count(error) AS errors FROM latency WHERE CAST(run_at AS DATE) = (SELECT max(CAST(run_at AS DATE)) FROM latency) GROUP BY strategy")
def latest_run(spark, folder):
    """Every day's results appended as a run of its own; the newest run is read alone."""
    path = new_folder(spark, "runs")
    readers.append_run(table(spark, folder, "latency", "strategy", "error", "run_at").select("strategy", "error", F.to_date("run_at").alias("run_id")), path)
    return readers.latest_run(spark, path).groupBy("strategy").agg(F.count("*").alias("rows"), F.count("error").alias("errors"))


@query("stored_sets", "SELECT source_name, count(*) AS entries, count(DISTINCT doc_id) AS ids, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM corpus GROUP BY source_name")
def stored_sets(spark, folder):
    """The corpus stored by set and read again."""
    path = new_folder(spark, "sets")
    readers.write_table(table(spark, folder, "corpus", "corpus_key", "doc_id", "text", "source_name"), path, "source_name")
    return spark.read.parquet(path).groupBy("source_name").agg(F.count("*").alias("entries"), F.count_distinct("doc_id").alias("ids"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query("prefix_cache", "SELECT substring(sha256(text), 1, 16) AS cache_key, substring(min(text), 1, 80) AS prefix FROM corpus WHERE text IS NOT NULL GROUP BY cache_key")
def prefix_cache(spark, folder):
    """Prefixes of all texts added to the cache in two runs; the second adds nothing."""
    path = new_folder(spark, "prefixes")
    rows = table(spark, folder, "corpus", "text").where("text IS NOT NULL").select(chunking.cache_key(F.col("text")).alias("cache_key"), F.substring("text", 1, 80).alias("prefix"))
    chunking.append_prefixes(rows, path)
    chunking.append_prefixes(rows, path)
    return spark.read.parquet(path)


@query("worker_pages", "SELECT pdf_path, page_num, arg_min(coalesce(markdown, ''), (parsed_at, page_id)) AS text FROM pages GROUP BY ALL")
def worker_pages(spark, folder):
    """A worker's output (log lines, then JSON of page number to text between marks) read back to pages."""
    first = table(spark, folder, "pages", "page_id", "pdf_path", "page_num", "markdown", "parsed_at").groupBy("pdf_path", "page_num").agg(F.min_by(F.coalesce("markdown", F.lit("")), F.struct("parsed_at", "page_id")).alias("text"))
    entries = first.groupBy("pdf_path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("page_num").cast("string"), "text"))).alias("m"))
    out = entries.select("pdf_path", F.concat(F.lit("loading model\n<<<JSON\n"), F.to_json("m"), F.lit("\nJSON>>>\ndone")).alias("out"))
    return out.select("pdf_path", F.explode(readers.page_texts(readers.between_tokens(F.col("out"), "<<<JSON", "JSON>>>"))).alias("page_num", "text"))


@query(
    "page_bleu",
    f"""WITH {M._PAIRS}, t AS (SELECT page_id, list_filter(regexp_split_to_array(pred, '[\\s\\x0B]+'), lambda x: x <> '') AS p, list_filter(regexp_split_to_array(gt, '[\\s\\x0B]+'), lambda x: x <> '') AS g FROM pr WHERE rn > 1),
a AS (SELECT page_id, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: array_to_string(p[i:i + n - 1], ' '))) AS gram FROM t, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(p) >= n),
b AS (SELECT page_id, n, unnest(list_transform(range(1, len(g) - n + 2), lambda i: array_to_string(g[i:i + n - 1], ' '))) AS gram FROM t, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE len(g) >= n),
ac AS (SELECT page_id, n, gram, count(*) AS c FROM a GROUP BY ALL), bc AS (SELECT page_id, n, gram, count(*) AS c FROM b GROUP BY ALL),
h AS (SELECT page_id, n, sum(least(ac.c, coalesce(bc.c, 0))) AS hits, sum(ac.c) AS total FROM ac LEFT JOIN bc USING (page_id, n, gram) GROUP BY ALL),
s AS (SELECT page_id, sum(ln(CASE WHEN hits > 0 THEN hits ELSE 0.1 END / total)) + (4 - count(*)) * ln(0.1) AS logs, max(CASE WHEN n = 1 THEN hits END) AS matched FROM h GROUP BY page_id)
SELECT page_id, CASE WHEN len(p) > 0 AND len(g) > 0 AND matched > 0 THEN round(100 * CASE WHEN len(p) > len(g) THEN 1 ELSE exp(1 - len(g) / len(p)) END * exp(logs / 4) + 1e-9, 2) ELSE 0.0 END AS bleu FROM t LEFT JOIN s USING (page_id)""",
)
def page_bleu(spark, folder):
    """BLEU of a page's later parses against its first."""
    return ngrams.bleu_scores(M._reparsed(spark, folder), "page_id", "pred", "gt")
