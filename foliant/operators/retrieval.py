"""Sparse, dense and hybrid top-k search, and reranking, as joins and windows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import materialize, spread, write_tidily

K1, B = 1.5, 0.75


def top_k(scored: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of every query, ranked from 1; ties by ``tie``."""
    order = Window.partitionBy(query).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def postings(texts: DataFrame, key: str, text: str, analyzer: Callable[[Column], Column] = T.tokens) -> DataFrame:
    """``key``, term, tf and the text's length in terms; texts without a term have no row. ``analyzer`` gives a text's terms."""
    t = texts.select(key, analyzer(F.col(text)).alias("ts"))
    return t.select(key, F.size("ts").alias("len"), F.explode("ts").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))


def term_statistics(posted: DataFrame, key: str, texts: int | Column) -> DataFrame:
    """term, df and idf = ln((N - df + 0.5) / (df + 0.5) + 1)."""
    n = F.lit(texts) if isinstance(texts, int) else texts
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


#: Terms of texts in a block, postings of a group of blocks that one task searches, and queries in a block, at most.
BLOCK_TERMS, GROUP_TERMS, BLOCK_QUERIES = 1_000_000, 4_000_000, 2048
#: What rounding a score to six places can hide, twice.
SLACK = 2e-6


def _packed(texts: DataFrame, block_terms: int) -> DataFrame:
    """Texts (corpus_key, ts) as inverted blocks, one row each: entries (key, length) in key order, terms and, term after term, entry and tf.

    The entries of a key stand in one block if its rows follow each other in one partition. Texts without a term have no entry.
    """

    def block(rows: list[pa.RecordBatch], name: str) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        keys, ts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns)
        lens = pc.list_value_length(ts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded, known = ts.flatten().dictionary_encode(), keys.dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(known.dictionary, null_placement="at_start").to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        of_key = rank[known.indices.to_numpy(zero_copy_only=False)]
        wide = int(lens.max()) + 1
        entries, entry = np.unique(of_key * wide + lens, return_inverse=True)
        found, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(entries) + np.repeat(entry, lens), return_counts=True)
        of_entry = known.dictionary.take(pa.array(order)).take(pa.array(entries // wide))
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values if isinstance(values, pa.Array) else pa.array(values.astype(kind)))
        sizes = np.bincount(found // len(entries), minlength=len(coded.dictionary))
        columns = [pa.array([name]), one(of_entry, None), one(entries % wide, np.int32), one(coded.dictionary, None), one(sizes, np.int32), one(found % len(entries), np.int32), one(tf, np.int32), pa.array([int(tf.sum())], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["block", "keys", "lens", "terms", "sizes", "docs", "tfs", "total"])

    def run(batches):
        held, size, made, part = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(1)), 0))
            ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(ends):
                if size >= block_terms and batch.column(0)[at] != held[-1].column(0)[-1]:
                    yield block(held, f"{part}-{made}")
                    held, size, made = [], 0, made + 1
                before = ends[at - 1] if at else 0
                # at least one row; a full block takes the rest of its last key
                to = at + 1 if size >= block_terms else max(at + 1, int(np.searchsorted(ends, before + block_terms - size)))
                held.append(batch.slice(at, to - at))
                size, at = size + int(ends[to - 1] - before), to
        if held:
            yield block(held, f"{part}-{made}")

    kind = texts.schema["corpus_key"].dataType.simpleString()
    return texts.mapInArrow(run, f"block string, keys array<{kind}>, lens array<int>, terms array<string>, sizes array<int>, docs array<int>, tfs array<int>, total bigint")


class _Block:
    """A block of texts in a worker: its terms' postings, weighed when a query first asks for them."""

    def __init__(self, name: str, row: Callable[[str], pa.Array], average: float):
        keys = row("keys").dictionary_encode(null_encoding="encode")
        self.name, self.keys, self.terms, self.average = name, keys.dictionary, row("terms"), average
        self.of_entry = keys.indices.to_numpy(zero_copy_only=False)
        self.lens, self.docs, self.tfs = (row(c).to_numpy() for c in ("lens", "docs", "tfs"))
        self.ends = np.concatenate([[0], np.cumsum(row("sizes").to_numpy(), dtype=np.int64)])
        self.once = len(self.keys) == len(self.lens)
        self.sums, self.weighed = np.zeros(len(self.keys)), {}

    def weights(self, term: int, idf: float) -> tuple[np.ndarray, np.ndarray, float]:
        """Numbers of the texts that hold the term, ascending, their weights and the greatest one."""
        if term not in self.weighed:
            a, b = self.ends[term], self.ends[term + 1]
            docs, tf = self.docs[a:b], self.tfs[a:b]
            w = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.lens[docs] / self.average))
            texts = docs.astype(np.intp)
            if not self.once:  # a key with texts of several lengths
                texts, place = np.unique(self.of_entry[docs].astype(np.intp), return_inverse=True)
                w = np.bincount(place, w)
            self.weighed[term] = (texts, w, float(w.max()))
        return self.weighed[term]

    def best(self, terms: list[tuple[np.ndarray, np.ndarray, float, float]], k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best texts of one query (all of them at least ``least``), ties by key, with their rounded scores.

        ``terms``: texts, weights, the query's weight and the most that the term adds, the heaviest first. Once the terms left can't lift a text
        that hasn't been met to the k-th best sum, they are only looked up for the texts that can still get there; all others are exact sums.
        """
        rest = np.cumsum([t[3] for t in terms[::-1]])[::-1]
        sums, met, many, at = self.sums, [], 0, 0
        while at < len(terms) and rest[at] >= least - SLACK:
            texts, w, wq, _ = terms[at]
            had = sums[texts]
            met.append(texts if not at else texts[had == 0])
            sums[texts] = had + wq * w
            many, at = many + len(met[-1]), at + 1
            if at < len(terms) and many >= k:
                least = max(least, float(np.partition(sums[np.concatenate(met)], many - k)[many - k]))
        if not many:
            return np.zeros(0, np.intp), np.zeros(0)
        some = np.concatenate(met)
        got = sums[some]
        sums[some] = 0.0
        if at < len(terms):
            near = got + rest[at] >= least - SLACK
            some, got = some[near], got[near]
            for texts, w, wq, _ in terms[at:]:
                place = np.minimum(np.searchsorted(texts, some), len(texts) - 1)
                got = got + np.where(texts[place] == some, wq * w[place], 0.0)
        near = got >= least - SLACK
        some, got = some[near], np.floor(got[near] * 1e6 + 0.5) / 1e6
        if len(some) > k:
            near = got >= np.partition(got, len(got) - k)[len(got) - k]
            some, got = some[near], got[near]
            order = np.lexsort((some, -got))[:k]
            some, got = some[order], got[order]
        return some, got


class _Asked:
    """A block of queries in a worker and what has been found for them so far."""

    def __init__(self, rows: pa.StructArray, k: int):
        lists = rows.field("terms")
        self.ids, self.k, each = rows.field("query_id"), k, lists.flatten()
        self.ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        self.terms, self.wq, self.idf = each.field("term"), each.field("wq").to_numpy(), each.field("idf").to_numpy()
        self.top = np.full((len(self.ids), k), -1.0)
        self.found: list[pa.Table] = []

    def search(self, block: _Block) -> None:
        places = pc.fill_null(pc.index_in(self.terms, value_set=block.terms), -1).to_numpy().tolist()
        rows, texts, scores = [], [], []
        for i in range(len(self.ids)):
            terms = []
            for j in range(self.ends[i], self.ends[i + 1]):
                if places[j] >= 0:
                    t, w, most = block.weights(places[j], self.idf[j])
                    terms.append((t, w, self.wq[j], self.wq[j] * most))
            if not terms:
                continue
            some, got = block.best(terms, self.k, self.top[i, 0])
            if len(some):
                self.top[i] = np.sort(np.concatenate([self.top[i], got]))[-self.k :]
                rows.append(np.full(len(some), i))
                texts.append(some)
                scores.append(got)
        if rows:
            self.found.append(pa.table({"i": np.concatenate(rows), "corpus_key": block.keys.take(pa.array(np.concatenate(texts))), "score": np.concatenate(scores)}))

    def results(self):
        if self.found:
            t = pa.concat_tables(self.found)
            t = t.take(pc.sort_indices(t, sort_keys=[("i", "ascending"), ("score", "descending"), ("corpus_key", "ascending")], null_placement="at_start"))
            i = t["i"].to_numpy()
            t = t.filter(pa.array(np.arange(len(i)) - np.searchsorted(i, i) < self.k))
            yield from pa.table({"query_id": self.ids.take(t["i"].combine_chunks()), "corpus_key": t["corpus_key"], "score": t["score"]}).combine_chunks().to_batches(10_000)


@dataclass
class Bm25Index:
    """Inverted blocks of texts (see ``_packed``), term statistics (term, df, idf), the number of texts, their mean length in terms and where
    the blocks are stored."""

    blocks: DataFrame
    terms: DataFrame
    texts: int
    average: float
    stored: str | None = None

    def search(self, queries: DataFrame, k: int = 3, mode: str = "reference", analyzer: Callable[[Column], Column] = T.tokens) -> DataFrame:
        """query_id, corpus_key, score, rank of the k best texts of every query.

        mode 'reference' weighs the query as a document, so idf counts twice; 'standard' gives each query term the weight of its count. Blocks of
        texts meet blocks of queries in tasks that keep k rows a query, so no pair of query and text is ever shuffled.
        """
        spark = self.blocks.sparkSession
        cores, average = spark.sparkContext.defaultParallelism, self.average
        tf, length = F.col("tf"), F.col("len")
        weight = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average))) if mode == "reference" else tf.cast("double")
        weighed = postings(queries, "query_id", "text", analyzer).join(self.terms, "term").where("idf > 0").select("query_id", "term", weight.alias("wq"), "idf").where("wq > 0")
        # the heaviest terms first, in one order everywhere, so equal texts have equal sums
        listed = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("wq") * F.col("idf")).alias("o"), "term", "wq", "idf"))).alias("terms"))
        many = queries.count()
        blocks = max(-(-many // BLOCK_QUERIES), min(2 * cores, -(-many // 64)), 1)
        dealt = listed.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).repartition(min(blocks, max(2 * cores, blocks // 16)), "qb")
        asked = materialize(dealt.groupBy("qb").agg(F.collect_list(F.struct("query_id", "terms")).alias("asked")), "asked")
        groups = max(1, -(-int(self.texts * average) // GROUP_TERMS))
        pairs = self.blocks.drop("total").coalesce(groups).crossJoin(asked.hint("shuffle_replicate_nl"))

        def run(batches):
            block, queries = None, {}
            for batch in batches:
                for i in range(batch.num_rows):
                    name, qb = batch["block"][i].as_py(), batch["qb"][i].as_py()
                    if block is None or block.name != name:
                        block = _Block(name, lambda c, i=i: batch[c][i].values, average)  # noqa: B023
                    if qb not in queries:
                        queries[qb] = _Asked(batch["asked"][i].values, k)
                    queries[qb].search(block)
            for each in queries.values():
                yield from each.results()

        kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "corpus_key": self.blocks.schema["keys"].dataType.elementType.simpleString()}
        found = pairs.mapInArrow(run, f"query_id {kinds['query_id']}, corpus_key {kinds['corpus_key']}, score double")
        return top_k(found, "query_id", "score", "corpus_key", k)


def bm25_index(corpus: DataFrame, analyzer: Callable[[Column], Column] = T.tokens, path: str | None = None, block_terms: int = BLOCK_TERMS) -> Bm25Index:
    """The index of ``corpus`` (corpus_key, content); its texts are analysed once. ``analyzer`` gives the terms of a text, the same for queries.

    The blocks are written under ``path`` if there is one. Postings are counted where the texts are read; texts move only if keys repeat or
    the scan has fewer tasks than the cluster has cores.
    """
    spark = corpus.sparkSession
    texts, keys, empty = corpus.agg(F.count("*"), F.count_distinct("corpus_key"), F.count_if(F.col("corpus_key").isNull())).first()
    rows = corpus.select("corpus_key", "content")
    if keys + (empty > 0) < texts:
        rows = rows.repartition("corpus_key").sortWithinPartitions("corpus_key")
    else:
        rows = spread(rows, "corpus_key")
    packed = _packed(rows.select("corpus_key", analyzer(F.col("content")).alias("ts")), block_terms)
    if path:
        write_tidily(packed, f"{path}/blocks", "overwrite")
        blocks = spark.read.schema(packed.schema).parquet(f"{path}/blocks")
    else:
        blocks = materialize(packed, "blocks")
    terms = blocks.agg(F.sum("total")).first()[0] or 0
    df = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy("t.terms").agg(F.sum("t.sizes").alias("df"))
    stats = df.select(F.col("terms").alias("term"), "df", F.log((texts - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return Bm25Index(blocks, stats, texts, terms / texts if texts and terms else 1.0, path)


def save_bm25(index: Bm25Index, path: str) -> None:
    """Writes an index (its blocks only if they don't stand there yet), the totals last: a folder without them is no index."""
    if index.stored != path:
        write_tidily(index.blocks, f"{path}/blocks", "overwrite")
    write_tidily(index.terms, f"{path}/terms", "overwrite")
    index.blocks.sparkSession.createDataFrame([(index.texts, index.average)], "texts long, average double").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def load_bm25(spark: SparkSession, path: str) -> Bm25Index:
    totals = spark.read.parquet(f"{path}/totals").first()
    return Bm25Index(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"), totals["texts"], totals["average"])


class IndexCache:
    """Indexes in a folder by (dense, sparse) pair: the pair's key names its index, whichever reranker or support goes with it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, dense: str, sparse: str, contextual: bool = False) -> str:
        return f"{self.folder}/{'ctx_' if contextual else ''}{dense}_{sparse}"

    def has(self, path: str) -> bool:
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/totals/_SUCCESS")
        return there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(there)

    def get_or_build(self, dense: str, sparse: str, chunks: DataFrame, contextual: bool = False, rebuild: bool = False) -> Bm25Index:
        """The stored index of the pair; built from ``chunks`` (corpus_key, content) and stored if there is none or ``rebuild`` is asked for."""
        path = self.path(dense, sparse, contextual)
        if rebuild or not self.has(path):
            save_bm25(bm25_index(chunks, path=path), path)
        return load_bm25(self.spark, path)


def bm25_search(corpus: DataFrame, queries: DataFrame, k: int = 3, mode: str = "reference") -> DataFrame:
    """query_id, corpus_key, score, rank of the k best texts of every query (see ``Bm25Index.search``).

    ``corpus``: corpus_key, content; ``queries``: query_id, text.
    """
    return bm25_index(corpus).search(queries, k, mode)


def keyword_score(query: Column, text: Column) -> Column:
    """How many of the query's words (each as often as it occurs) are contained in the text, without regard to case."""
    return F.size(F.filter(T.words(F.lower(query)), lambda w: F.contains(F.lower(text), w)))


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = 5, query_block: int = 512, vector_block: int = 8192) -> DataFrame:
    """qid, vec_id, cosine, rank: exact cosine top-k of a stated query set against all vectors, block by block.

    Both sides are dealt into blocks of bounded size by hash, at least one for each core; each pair of blocks is one matrix product in a task that
    keeps k rows a query, and a window picks the best of those. A vector doesn't find itself. Null, empty and zero vectors are left out.
    """
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x) > 0)
    n, m = vectors.count(), queries.count()
    vector_blocks = max(-(-n // vector_block), min(cores, -(-n // 256)), 1)

    def blocks(df: DataFrame, key: str, name: str, many: int) -> DataFrame:
        # a block is bounded by construction: rows are dealt by hash to as many blocks as their number asks for
        return df.where(usable).withColumn(name, F.pmod(F.xxhash64(key), F.lit(many))).groupBy(name).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col("embedding").alias("v"))).alias(f"{name}_rows"))

    q = blocks(queries.select("qid", "embedding"), "qid", "qb", max(1, -(-m // query_block)))
    v = blocks(vectors.select("vec_id", "embedding"), "vec_id", "vb", vector_blocks)
    # one row for each pair of blocks, not of vectors
    pairs = q.withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1)))).repartition(max(cores, vector_blocks), "vb").join(v, "vb")

    def run(batches):
        for batch in batches:
            for a, b in zip(batch["qb_rows"], batch["vb_rows"]):
                qi, vi = np.array([r["id"] for r in a]), np.array([r["id"] for r in b])
                qm, vm = (np.array([np.asarray(r["v"], dtype=np.float64) for r in x]) for x in (a, b))
                cos = (qm / np.linalg.norm(qm, axis=1, keepdims=True)) @ (vm / np.linalg.norm(vm, axis=1, keepdims=True)).T
                cos = np.where(qi[:, None] == vi[None, :], -9.0, cos.round(6))
                # all that reach the k-th value, ties too, then the k first of each query
                least = np.partition(cos, -k, axis=1)[:, -k] if len(vi) > k else np.full(len(qi), -2.0)
                rows, cols = np.nonzero((cos >= least[:, None]) & (cos > -2))
                order = np.lexsort((vi[cols], -cos[rows, cols], rows))
                rows, cols = rows[order], cols[order]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                rows, cols = rows[place < k], cols[place < k]
                yield pd.DataFrame({"qid": qi[rows], "vec_id": vi[cols], "cosine": cos[rows, cols]})

    found = pairs.select("qb_rows", "vb_rows").mapInPandas(run, "qid bigint, vec_id bigint, cosine double")
    return top_k(found, "qid", "cosine", "vec_id", k)


def reciprocal_rank_fusion(lists: list[DataFrame], query: str, item: str, k: int, c: int = 60) -> DataFrame:
    """Ranked lists (query, item, rank) as one: score = sum of 1 / (c + rank)."""
    both = lists[0].select(query, item, "rank")
    for other in lists[1:]:
        both = both.unionByName(other.select(query, item, "rank"))
    return top_k(both.groupBy(query, item).agg(F.round(F.sum(1 / (F.lit(c) + F.col("rank"))), 8).alias("score")), query, "score", item, k)


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query vector its best dot product with a document vector, summed. Arrays of arrays."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def pooled_terms(logits: DataFrame, key: str) -> DataFrame:
    """``key``, term and the largest log(1 + relu(logit)) of that term; zero weights are left out."""
    return logits.groupBy(key, "term").agg(F.round(F.max(F.log1p(F.greatest("logit", F.lit(0.0)))), 6).alias("weight")).where("weight > 0")
