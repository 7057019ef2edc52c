"""Search queries over corpus, queries, qrels, answers and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import chunking, retrieval, strategies
from foliant.plans.base import query, strip
from foliant.sources.tables import table

K = 3
_CONTENT = "CASE WHEN coalesce(title, '') <> '' AND NOT starts_with(coalesce(text, ''), title) THEN title || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END"
_CORPUS = f"SELECT corpus_key, doc_id, {_CONTENT} AS content FROM corpus"


def _content():
    title, body = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    return F.when((title != "") & ~F.startswith(body, title), F.concat(title, F.lit("\n\n"), body)).otherwise(body)


def _corpus(spark, folder):
    return table(spark, folder, "corpus", "corpus_key", "doc_id", "title", "text").select("corpus_key", "doc_id", _content().alias("content"))


def _queries(spark, folder):
    return table(spark, folder, "queries", "query_id", "text")


@query("beir_corpus", f"SELECT corpus_key, doc_id, content, CASE WHEN title IS NULL THEN 'text' ELSE 'both' END AS kind FROM ({_CORPUS}) JOIN (SELECT corpus_key, title FROM corpus) USING (corpus_key) WHERE {strip('content')} <> ''")
def beir_corpus(spark, folder):
    df = table(spark, folder, "corpus", "corpus_key", "doc_id", "title", "text").withColumn("content", _content())
    return df.where(T.strip_ends(F.col("content")) != "").select("corpus_key", "doc_id", "content", F.when(F.col("title").isNull(), "text").otherwise("both").alias("kind"))


@query("beir_qrels", "SELECT DISTINCT query_id, doc_id, score FROM qrels SEMI JOIN queries USING (query_id) SEMI JOIN corpus USING (doc_id) WHERE score IS NOT NULL")
def beir_qrels(spark, folder):
    qrels = table(spark, folder, "qrels").where("score IS NOT NULL").distinct()
    return qrels.join(table(spark, folder, "queries", "query_id"), "query_id", "left_semi").join(table(spark, folder, "corpus", "doc_id"), "doc_id", "left_semi").select("query_id", "doc_id", "score")


@query(
    "qa_pairs",
    f"""WITH best AS (SELECT query_id, arg_max(doc_id, (coalesce(score, -1), -length(doc_id), doc_id)) AS doc_id FROM qrels GROUP BY query_id),
d AS (SELECT doc_id, min_by(content, corpus_key) AS ground_truth FROM ({_CORPUS}) GROUP BY doc_id)
SELECT query_id, text AS question, coalesce(ground_truth, '') AS ground_truth FROM queries LEFT JOIN best USING (query_id) LEFT JOIN d USING (doc_id) WHERE {strip("coalesce(text, '')")} <> ''""",
)
def qa_pairs(spark, folder):
    best = table(spark, folder, "qrels").groupBy("query_id").agg(F.max_by("doc_id", F.struct(F.coalesce("score", F.lit(-1)), -F.length("doc_id"), "doc_id")).alias("doc_id"))
    first = _corpus(spark, folder).groupBy("doc_id").agg(F.min_by("content", "corpus_key").alias("ground_truth"))
    asked = _queries(spark, folder).where(T.strip_ends(F.coalesce("text", F.lit(""))) != "")
    return asked.join(best, "query_id", "left").join(first, "doc_id", "left").select("query_id", F.col("text").alias("question"), F.coalesce("ground_truth", F.lit("")).alias("ground_truth"))


@query("dedup_first", "SELECT corpus_key, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY corpus_key) AS rn FROM corpus) WHERE rn = 1")
def dedup_first(spark, folder):
    return table(spark, folder, "corpus", "corpus_key", "doc_id").groupBy("doc_id").agg(F.min("corpus_key").alias("corpus_key")).select("corpus_key", "doc_id")


@query("dedup_last", "SELECT corpus_key, doc_id, title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY corpus_key DESC) AS rn FROM corpus) WHERE rn = 1")
def dedup_last(spark, folder):
    return table(spark, folder, "corpus", "corpus_key", "doc_id", "title").groupBy("doc_id").agg(F.max("corpus_key").alias("corpus_key"), F.max_by(F.struct("title"), "corpus_key").alias("s")).select("corpus_key", "doc_id", "s.title")


@query("corpus_sample", "SELECT corpus_key, doc_id FROM corpus ORDER BY md5(corpus_key || ':42'), corpus_key LIMIT 100")
def corpus_sample(spark, folder):
    """The sampling operator: 100 entries without replacement, by hash with a seed."""
    return table(spark, folder, "corpus", "corpus_key", "doc_id").orderBy(F.md5(F.concat(F.col("corpus_key").cast("string"), F.lit(":42"))), "corpus_key").limit(100)


@query("subset_filter", "SELECT query_id, doc_id FROM qrels WHERE starts_with(query_id, 'q0') OR starts_with(query_id, 'qa') OR ends_with(doc_id, '7')")
def subset_filter(spark, folder):
    keep = F.startswith("query_id", F.lit("q0")) | F.startswith("query_id", F.lit("qa")) | F.endswith("doc_id", F.lit("7"))
    return table(spark, folder, "qrels").where(keep).select("query_id", "doc_id")


_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_STATS = f"""
WITH c AS ({_CORPUS}), toks AS (SELECT corpus_key, {_TOK.format('content')} AS ts FROM c),
p AS (SELECT corpus_key, len, term, count(*) AS tf FROM (SELECT corpus_key, length(ts) AS len, unnest(ts) AS term FROM toks) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(length(ts)) AS a FROM toks),
st AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM st, n),
wd AS (SELECT corpus_key, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a)) AS wd FROM p JOIN i USING (term), n),
qt AS (SELECT query_id, {_TOK.format('text')} AS ts FROM queries),
qp AS (SELECT query_id, len, term, count(*) AS tf FROM (SELECT query_id, length(ts) AS len, unnest(ts) AS term FROM qt) GROUP BY ALL),
wr AS (SELECT query_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / a)) AS wq FROM qp JOIN i USING (term), n),
ws AS (SELECT query_id, term, CAST(tf AS DOUBLE) AS wq FROM qp)
"""
_TOP = ", s AS (SELECT query_id, corpus_key, round(sum(wq * wd), 6) AS score FROM {} JOIN wd USING (term) GROUP BY ALL), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_key) AS INTEGER) AS rank FROM s QUALIFY rank <= {})"


@query("bm25_stats", _STATS + "SELECT term, df, round(idf, 6) AS idf FROM i")
def bm25_stats(spark, folder):
    posted = retrieval.postings(_corpus(spark, folder), "corpus_key", "content")
    n = _corpus(spark, folder).count()
    return retrieval.term_statistics(posted, "corpus_key", n).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", _STATS + _TOP.format("wr", K) + "SELECT query_id, corpus_key, score, rank FROM top")
def bm25_topk(spark, folder):
    return retrieval.bm25_search(_corpus(spark, folder), _queries(spark, folder), K).select("query_id", "corpus_key", "score", "rank")


@query("bm25_topk_standard", _STATS + _TOP.format("ws", K) + "SELECT query_id, corpus_key, score, rank FROM top")
def bm25_topk_standard(spark, folder):
    return retrieval.bm25_search(_corpus(spark, folder), _queries(spark, folder), K, "standard").select("query_id", "corpus_key", "score", "rank")


_KEYWORD = f"""
WITH pairs AS (SELECT DISTINCT query_id, doc_id FROM qrels), c AS (SELECT doc_id, corpus_key, unnest(list_filter(string_split(content, chr(10) || chr(10)), lambda x: x <> '')) AS chunk, CAST(generate_subscripts(list_filter(string_split(content, chr(10) || chr(10)), lambda x: x <> ''), 1) - 1 AS INTEGER) AS pos FROM ({_CORPUS})),
s AS (SELECT query_id, corpus_key, pos, chunk, CAST(length(list_filter(regexp_split_to_array(lower(text), '[\\s\\x0B]+'), lambda w: w <> '' AND contains(lower(chunk), w))) AS INTEGER) AS score FROM pairs JOIN queries USING (query_id) JOIN c USING (doc_id)),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_key, pos) AS INTEGER) AS rank FROM s WHERE score > 0 QUALIFY rank <= {K})
"""


def _keyword(spark, folder):
    chunks = _corpus(spark, folder).select("doc_id", "corpus_key", F.posexplode(F.filter(F.split("content", "\n\n"), lambda x: x != "")).alias("pos", "chunk"))
    pairs = table(spark, folder, "qrels", "query_id", "doc_id").distinct()
    scored = pairs.join(_queries(spark, folder), "query_id").join(chunks, "doc_id").select("query_id", "corpus_key", "pos", "chunk", retrieval.keyword_score(F.col("text"), F.col("chunk")).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_key", "pos")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)


@query("keyword_topk", _KEYWORD + "SELECT query_id, corpus_key, pos, score, rank FROM top")
def keyword_topk(spark, folder):
    """Keyword search inside the documents named for a query, best chunks first."""
    return _keyword(spark, folder).select("query_id", "corpus_key", "pos", "score", "rank")


@query(
    "context_window",
    _KEYWORD
    + """SELECT query_id, 'Found ' || count(*) || ' passages.' AS answer, string_agg('[' || rank || '] (' || corpus_key || ' p.' || pos || ') ' || substring(chunk, 1, 300), chr(10) || chr(10) ORDER BY rank) AS context FROM top GROUP BY query_id""",
)
def context_window(spark, folder):
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.col("corpus_key").cast("string"), F.lit(" p."), F.col("pos").cast("string"), F.lit(") "), F.substring("chunk", 1, 300))
    return _keyword(spark, folder).groupBy("query_id").agg(
        F.concat(F.lit("Found "), F.count("*").cast("string"), F.lit(" passages.")).alias("answer"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda r: r["line"]), "\n\n").alias("context")
    )


@query(
    "citations",
    """SELECT answer_id, c.chunk_id AS chunk_id, c.source_path AS source_path, c.page_number AS page_number, substring(c.text_snippet, 1, 200) AS snippet, coalesce(c.relevance_score, 0.0) AS relevance FROM (SELECT answer_id, unnest(citations) AS c FROM answers)""",
)
def citations(spark, folder):
    return table(spark, folder, "answers", "answer_id", "citations").select("answer_id", F.explode("citations").alias("c")).select(
        "answer_id", "c.chunk_id", "c.source_path", "c.page_number", F.substring("c.text_snippet", 1, 200).alias("snippet"), F.coalesce("c.relevance_score", F.lit(0.0)).alias("relevance")
    )


_COS = "round(list_dot_product(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(v.embedding, lambda x: CAST(x AS DOUBLE))) / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(v.embedding, lambda x: CAST(x AS DOUBLE) * x)))), 6)"
_DENSE = "d AS (SELECT q.vec_id AS qid, v.vec_id AS vec_id, {cos} AS cosine FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id), dt AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM d QUALIFY rank <= {k})"


def _dense(spark, folder, k):
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding")
    return retrieval.dense_search(vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding"), vectors, k)


@query("dense_topk", "WITH " + _DENSE.format(cos=_COS, k=5) + " SELECT qid, vec_id, cosine, rank FROM dt")
def dense_topk(spark, folder):
    return _dense(spark, folder, 5).select("qid", "vec_id", "cosine", "rank")


_MAXSIM = """, m AS (SELECT qid, dt.vec_id, round(list_sum(list_transform([0, 1, 2, 3], lambda i: list_max(list_transform([0, 1, 2, 3], lambda j: list_dot_product(
  list_transform(q.embedding[i * 16 + 1 : i * 16 + 16], lambda x: CAST(x AS DOUBLE)), list_transform(v.embedding[j * 16 + 1 : j * 16 + 16], lambda x: CAST(x AS DOUBLE))))))), 6) AS score
  FROM dt JOIN embeddings q ON q.vec_id = qid JOIN embeddings v ON v.vec_id = dt.vec_id)"""


@query("maxsim_rerank", "WITH " + _DENSE.format(cos=_COS, k=20) + _MAXSIM + " SELECT qid, vec_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM m QUALIFY rank <= 5")
def maxsim_rerank(spark, folder):
    """Two stages: 20 candidates by cosine, then late interaction over each vector's four parts, 5 kept."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 16 + 1, F.lit(16)))
    vectors = table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", parts.alias("m"))
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("m").alias("qm"))
    found = _dense(spark, folder, 20).select("qid", "vec_id").join(asked, "qid").join(vectors, "vec_id")
    scored = found.select("qid", "vec_id", F.round(retrieval.max_sim(F.col("qm"), F.col("m")), 6).alias("score"))
    return retrieval.top_k(scored, "qid", "score", "vec_id", 5).select("qid", "vec_id", "score", "rank")


@query(
    "hybrid_rrf",
    _STATS
    + _TOP.format("wr", 20)
    + ", "
    + _DENSE.format(cos=_COS, k=20)
    + """, l AS (SELECT q.query_key AS qid, t.corpus_key AS item, t.rank FROM top t JOIN queries q USING (query_id) WHERE q.query_key % 20 = 0 UNION ALL SELECT qid, vec_id, rank FROM dt),
f AS (SELECT qid, item, round(sum(1.0 / (60 + rank)), 8) AS score FROM l GROUP BY ALL)
SELECT qid, item, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS INTEGER) AS rank FROM f QUALIFY rank <= 5""",
)
def hybrid_rrf(spark, folder):
    """Sparse and dense lists of the query set (keys divisible by 20) fused by reciprocal rank; vectors and entries share their keys."""
    asked = table(spark, folder, "queries", "query_key", "query_id", "text").where("query_key % 20 = 0")
    sparse = retrieval.bm25_search(_corpus(spark, folder), asked.select("query_id", "text"), 20).join(asked.select("query_key", "query_id"), "query_id").select(F.col("query_key").alias("qid"), F.col("corpus_key").alias("item"), "rank")
    dense = _dense(spark, folder, 20).select("qid", F.col("vec_id").alias("item"), "rank")
    return retrieval.reciprocal_rank_fusion([sparse, dense], "qid", "item", 5).select("qid", "item", "score", "rank")


@query("splade_pool", "SELECT vec_id, CAST((i - 1) % 16 AS INTEGER) AS term, round(max(ln(1 + greatest(CAST(x AS DOUBLE), 0))), 6) AS weight FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL HAVING weight > 0")
def splade_pool(spark, folder):
    logits = table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", (F.col("i") % 16).alias("term"), F.col("x").cast("double").alias("logit"))
    return retrieval.pooled_terms(logits, "vec_id")


_JUDGED = _STATS + _TOP.format("wr", 10) + """, rel AS (SELECT DISTINCT query_id, doc_id FROM qrels WHERE score > 0 AND doc_id IN (SELECT doc_id FROM corpus)),
hits AS (SELECT query_id, doc_id, min(rank) AS rank FROM top JOIN c USING (corpus_key) GROUP BY ALL),
j AS (SELECT r.query_id, r.doc_id, h.rank FROM rel r LEFT JOIN hits h USING (query_id, doc_id))"""


def _judged(spark, folder):
    found = retrieval.bm25_search(_corpus(spark, folder), _queries(spark, folder), 10)
    hits = found.join(table(spark, folder, "corpus", "corpus_key", "doc_id"), "corpus_key").groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    relevant = table(spark, folder, "qrels").where("score > 0").select("query_id", "doc_id").distinct().join(table(spark, folder, "corpus", "doc_id"), "doc_id", "left_semi")
    return relevant.join(hits, ["query_id", "doc_id"], "left")


@query("recall_at_k", _JUDGED + "SELECT query_id, count(*) AS relevant, count(rank) AS found, round(count(rank) / count(*), 6) AS recall, round(coalesce(1.0 / min(rank), 0), 6) AS reciprocal_rank FROM j GROUP BY query_id")
def recall_at_k(spark, folder):
    """Extension: recall@10 and reciprocal rank of the sparse search against the relevance judgements."""
    return _judged(spark, folder).groupBy("query_id").agg(
        F.count("*").alias("relevant"), F.count("rank").alias("found"), F.round(F.count("rank") / F.count("*"), 6).alias("recall"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank")
    )


@query(
    "ndcg_at_k",
    _JUDGED + ", g AS (SELECT query_id, sum(CASE WHEN rank IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) AS dcg, count(*) AS n FROM j GROUP BY query_id) SELECT query_id, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM g",
)
def ndcg_at_k(spark, folder):
    """Extension: nDCG@10 with binary gains."""
    gains = _judged(spark, folder).groupBy("query_id").agg(F.sum(F.when(F.col("rank").isNull(), 0.0).otherwise(1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return gains.select("query_id", F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


@query(
    "reranked_topk",
    _STATS
    + _TOP.format("wr", 20)
    + f""", t AS (SELECT query_id, corpus_key, round(CAST(length(list_filter(regexp_split_to_array(lower(text), '[\\s\\x0B]+'), lambda w: w <> '' AND contains(lower(content), w))) AS DOUBLE) + score * 1e-9, 9) AS score FROM top JOIN queries USING (query_id) JOIN c USING (corpus_key))
SELECT query_id, corpus_key AS chunk_key, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_key) AS INTEGER) AS rank FROM t QUALIFY rank <= {K}""",
)
def reranked_topk(spark, folder):
    """A composed strategy: 20 candidates of the sparse one, reranked by the words of the query that a text contains."""
    chunks = _corpus(spark, folder).select(F.col("corpus_key").alias("chunk_key"), "content")
    # texts without a word count among the texts, as the SQL has it
    index = retrieval.bm25_index(chunks.withColumnRenamed("chunk_key", "corpus_key"))
    composed = strategies.Reranked(strategies.SparseStrategy(stored=index), chunks)
    return composed.retrieve(_queries(spark, folder), K).select("query_id", "chunk_key", "score", "rank")
