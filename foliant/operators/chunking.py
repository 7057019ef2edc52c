"""Chunks with provenance, and the context that is put before them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import materialize


def document_id(path: Column) -> Column:
    """First 12 hexadecimal figures of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 12)


def text_id(text: Column, prefix: Column | str) -> Column:
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, F.lit("_"), F.substring(F.md5(text), 1, 12))


def cache_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def packed_paragraphs(text: Column, size: Column, overlap: Column, separator: Column) -> Column:
    """Greedy packing of paragraphs as an array of chunks.

    A paragraph that doesn't fit with what is waiting sends that off as a chunk; the next begins with the chunk's last ``overlap``
    characters. A paragraph is never cut, so a chunk may exceed the size. Null and blank texts give no chunk.
    """
    paragraphs = F.split(text, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), -1)
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        full = (F.length(cur) + F.length(p) + F.length(separator) > size) & (cur != "")
        tail = F.when(overlap > 0, F.concat(F.when(F.length(cur) > overlap, F.right(cur, overlap)).otherwise(cur), separator, p)).otherwise(p)
        joined = F.when(cur != "", F.concat(cur, separator, p)).otherwise(p)
        return F.struct(F.when(full, tail).otherwise(joined).alias("cur"), F.when(full, F.concat(acc["out"], F.array(T.strip_ends(cur)))).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        last = T.strip_ends(acc["cur"])
        return F.when(last != "", F.concat(acc["out"], F.array(last))).otherwise(acc["out"])

    return F.when(T.strip_ends(text) != "", F.aggregate(paragraphs, start, step, finish))


def chunk_pages(pages: DataFrame, configs: DataFrame) -> DataFrame:
    """One row a chunk of each parsed page: page_id, doc_id, page_num, chunk_id, idx, chunk_text. ``configs`` is a list of settings."""
    joined = pages.join(F.broadcast(configs), "config_id")
    chunks = packed_paragraphs(F.col("markdown"), F.col("chunk_size"), F.col("chunk_overlap"), F.col("separator"))
    return joined.select("page_id", document_id(F.col("pdf_path")).alias("doc_id"), "page_num", "bbox_data", F.posexplode(chunks).alias("idx", "chunk_text")).select(
        "page_id", "doc_id", "page_num", F.format_string("p%d_c%d", "page_num", "idx").alias("chunk_id"), "idx", "chunk_text", "bbox_data"
    )


def chunk_boxes(chunks: DataFrame) -> DataFrame:
    """The rectangle around the page's words that occur in the chunk; null without boxes or common words."""
    words = F.transform(T.words(F.col("chunk_text")), F.lower)
    hits = F.filter("bbox_data", lambda b: F.array_contains(words, F.lower(T.strip_ends(b["text"]))))
    with_hits = chunks.withColumn("hits", hits)
    edge = lambda f, name: f(F.transform("hits", lambda b: b[name]))
    return with_hits.select("page_id", "chunk_id", edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1"))


def recursive_split(text: str, size: int = 500, overlap: int = 100, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Splits at the first separator that occurs, packs the parts up to ``size`` with up to ``overlap`` characters kept, and goes on with the next separator inside parts that are too long."""
    separator = next(s for s in separators if s == "" or s in text)
    finer = separators[separators.index(separator) + 1 :]
    parts = [p for p in (list(text) if separator == "" else text.split(separator)) if p != ""]
    out: list[str] = []
    waiting: list[str] = []

    def send() -> None:
        joined = separator.join(waiting).strip()
        if joined:
            out.append(joined)

    def length(parts: list[str]) -> int:
        return sum(map(len, parts)) + len(separator) * max(0, len(parts) - 1)

    for part in parts:
        if len(part) > size and finer:
            send()
            waiting = []
            out += recursive_split(part, size, overlap, finer)
            continue
        if waiting and length([*waiting, part]) > size:
            send()
            while waiting and (length(waiting) > overlap or length([*waiting, part]) > size):
                waiting.pop(0)
        waiting.append(part)
    send()
    return out


def child_chunks(parents: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """``key``, idx and text of every child chunk; blank parents have none."""

    @F.pandas_udf("array<string>")
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda t: recursive_split(t, size, overlap) if isinstance(t, str) and t.strip() else [])

    return parents.select(key, F.posexplode(cut(text)).alias("idx", "text"))


def enrich(chunks: DataFrame, parents: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with the cached prefix of their hash before them: chunk columns, ``status`` and ``enriched_text``.

    status: cached (prefix known), missing (no prefix yet; text stays as it is), orphan (no parent text to make one from).
    """
    found = chunks.withColumn("hash", cache_key(F.col("chunk_text"))).join(parents.select("parent_id", "parent_text"), "parent_id", "left").join(cache.select("hash", "prefix"), "hash", "left")
    known = F.coalesce(F.col("prefix"), F.lit("")) != ""
    return found.select(
        "parent_id", "idx", "chunk_text", F.when(known, "cached").when(F.coalesce("parent_text", F.lit("")) == "", "orphan").otherwise("missing").alias("status"),
        F.when(known, F.concat("prefix", F.lit("\n\n"), "chunk_text")).otherwise(F.col("chunk_text")).alias("enriched_text"), F.when(known, F.col("chunk_text")).alias("original_content"),
    )


def append_prefixes(prefixes: DataFrame, cache: str) -> int:
    """Adds prefixes (cache_key, prefix) that the cache table doesn't hold yet, each key once; gives how many. An interrupted run keeps what was added."""
    spark = prefixes.sparkSession
    new = prefixes.where("cache_key IS NOT NULL AND prefix IS NOT NULL").groupBy("cache_key").agg(F.min("prefix").alias("prefix"))
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        new = new.join(spark.read.parquet(cache).select("cache_key"), "cache_key", "left_anti")
    new = materialize(new, "new-prefixes")  # read before the cache grows
    new.write.mode("append").parquet(cache)
    return new.count()
