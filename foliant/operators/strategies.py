"""Retrieval strategies that compose, and running a benchmark over all of them at once."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import retrieval

#: Evaluation metrics as (name, tier, needs a reference, needs a judge).
METRICS = (
    ("faithfulness", 1, False, True), ("answer_relevancy", 1, False, True), ("context_precision", 1, True, True), ("context_recall", 1, True, True), ("factual_correctness", 2, True, True),
    ("context_entity_recall", 2, True, True), ("noise_sensitivity", 2, True, True), ("semantic_similarity", 2, True, False), ("response_relevancy", 2, False, True), ("string_presence", 3, True, False),
    ("exact_match", 3, True, False), ("string_similarity", 3, True, False), ("bleu_score", 3, True, False), ("rouge_score", 3, True, False), ("aspect_critic", 3, False, True),
)
CORE = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def metrics(preset: str = "core", has_reference: bool = True) -> list[str]:
    """Metric names of a preset (core, full, reference_free, lightweight); without references those that need one are left out."""
    chosen = {"core": lambda m: m[0] in CORE, "full": lambda m: True, "reference_free": lambda m: not m[2], "lightweight": lambda m: not m[3]}
    if preset not in chosen:
        raise KeyError(f"unknown preset {preset!r}; available: {', '.join(chosen)}")
    return [m[0] for m in METRICS if chosen[preset](m) and (has_reference or not m[2])]


class Strategy(Protocol):
    """``index`` takes chunks once; ``retrieve`` answers all queries in one plan with query_id, chunk_key, score, rank."""

    name: str

    def index(self, chunks: DataFrame) -> None: ...

    def retrieve(self, queries: DataFrame, k: int = 5) -> DataFrame: ...


class SparseStrategy:
    """BM25 over chunks (chunk_key, content), or over an index ``stored`` that several strategies share."""

    def __init__(self, name: str = "bm25", mode: str = "reference", stored: retrieval.Bm25Index | None = None):
        self.name, self.mode, self.chunks, self.stored = name, mode, None, stored

    def index(self, chunks: DataFrame) -> None:
        self.chunks, self.stored = chunks.where(F.length(F.trim("content")) > 0).select(F.col("chunk_key").alias("corpus_key"), "content"), None

    def retrieve(self, queries: DataFrame, k: int = 5) -> DataFrame:
        if self.chunks is None and self.stored is None:
            raise ValueError(f"{self.name} has no index")
        index = self.stored or retrieval.bm25_index(self.chunks)
        return index.search(queries, k, self.mode).withColumnRenamed("corpus_key", "chunk_key").select("query_id", "chunk_key", "score", "rank")


class Reranked:
    """Takes ``depth`` candidates of another strategy and keeps the k best by ``scorer(query text, chunk text)``, a Column function.

    Without a scorer the share of the query's words that the chunk contains decides.
    """

    def __init__(self, inner: Strategy, chunks: DataFrame, scorer: Callable[[Column, Column], Column] | None = None, depth: int = 20):
        self.inner, self.chunks, self.depth = inner, chunks, depth
        self.scorer = scorer or (lambda q, t: retrieval.keyword_score(q, t).cast("double"))
        self.name = f"{inner.name}+rerank"

    def index(self, chunks: DataFrame) -> None:
        self.chunks = chunks
        self.inner.index(chunks)

    def retrieve(self, queries: DataFrame, k: int = 5) -> DataFrame:
        found = self.inner.retrieve(queries, self.depth).select("query_id", "chunk_key", F.col("score").alias("first_score"))
        texts = found.join(queries, "query_id").join(self.chunks.select("chunk_key", "content"), "chunk_key")
        scored = texts.select("query_id", "chunk_key", F.round(self.scorer(F.col("text"), F.col("content")) + F.col("first_score") * 1e-9, 9).alias("score"))
        return retrieval.top_k(scored, "query_id", "score", "chunk_key", k)


def run(strategies: list[Strategy], queries: DataFrame, k: int = 5, done: DataFrame | None = None) -> DataFrame:
    """All strategies over all queries: strategy, query_id, num_results, results, error. Results that ``done`` holds for a known strategy are taken over.

    A strategy that can't be planned gives its error for every query and doesn't stop the others; one that judges queries apart may give a column
    ``error`` beside its rows, which stands at the query.
    """
    out = None
    have = set() if done is None else {r[0] for r in done.select("strategy").distinct().collect()}  # as many as strategies
    for s in strategies:
        if s.name in have:
            continue
        try:
            found = s.retrieve(queries, k)
            found.schema  # a plan that can't be resolved fails here
        except Exception as e:
            rows = queries.select(F.lit(s.name).alias("strategy"), "query_id", F.lit(0).alias("num_results"), F.lit(None).cast("array<struct<rank:int,chunk_key:bigint,score:double>>").alias("results"), F.lit(f"{type(e).__name__}: {e}").alias("error"))
        else:
            error = F.max("error") if "error" in found.columns else F.max(F.lit(None).cast("string"))
            hits = F.filter(F.collect_list(F.struct("rank", "chunk_key", "score")), lambda x: x["rank"].isNotNull())
            listed = found.groupBy("query_id").agg(F.array_sort(hits).alias("results"), error.alias("error"))
            rows = queries.select("query_id").join(listed, "query_id", "left").select(F.lit(s.name).alias("strategy"), "query_id", F.coalesce(F.size("results"), F.lit(0)).alias("num_results"), "results", "error")
        out = rows if out is None else out.unionByName(rows)
    if done is not None:
        kept = done.where(F.col("strategy").isin([s.name for s in strategies])).select("strategy", "query_id", "num_results", "results", "error")
        out = kept if out is None else out.unionByName(kept)
    return out


def filled_answers(rows: DataFrame, generated: Column | None = None, missing: str = "No answer was generated.") -> DataFrame:
    """Given answers stay; where one is missing the generator's column or a constant stands."""
    parts = [F.nullif("answer", F.lit(""))] + ([generated] if generated is not None else []) + [F.lit(missing)]
    return rows.withColumn("answer", F.coalesce(*parts))


def exactly(values: Column, n: int) -> Column:
    """An array of n entries: cut, or filled up with empty ones."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(""), n)), 1, n)
