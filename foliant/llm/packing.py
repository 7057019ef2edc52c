"""Problem 8: fill containers of fixed capacity with documents by minimum bin slack.

Only sizes matter for a good filling, so it is planned on the histogram of sizes, which has at most ``capacity`` entries whatever the
number of documents. A window is one pattern: the largest size left, plus the multiset of other sizes that a bitset subset-sum
finds to come closest to the capacity; backtracking gives how many of each size. A pattern is used as often as the counts allow, so each
pattern exhausts a size and there are about as many patterns as sizes. Documents are numbered within their size by a two-level running
count, salted by hash so that a size that holds a third of all documents isn't numbered in one task, and each number belongs to one
container of the plan.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import vocabularies as V
from foliant.session import materialize, spread

#: Documents for each salt of a hot size.
PER_SALT = 500_000
_WORD_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


class TokenCounter:
    """Counts tokens by pretoken, with each pretoken's count remembered up to ``keep`` entries; equals the tokenizer's own length."""

    def __init__(self, name: str, path: str, keep: int = 400_000):
        self.name, self.path, self.keep = name, path, keep
        self.word = name.startswith("word")
        self.known: dict[str, int] = {}

    def _split(self, text: str) -> list[str]:
        if not self.word:
            return V.byte_pretokens(text)
        plain = V.is_plain(text)
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        if not plain:
            text = V.full_pattern(r"\s+").sub(" ", text)
        return (_WORD_PLAIN if plain else V.full_pattern(V.WORD_PATTERN)).findall(text.lower())

    def counts(self, pieces: Counter) -> int:
        new = [p for p in pieces if p not in self.known]
        if new:
            if len(self.known) > self.keep:
                self.known.clear()
                new = list(pieces)
            if self.word:
                tokenizer = V.json_tokenizer(self.name, self.path)
                self.known.update(zip(new, (len(e.ids) for e in tokenizer.encode_batch(new, add_special_tokens=False))))
            else:
                encoding = V.byte_encoding(self.name, self.path)
                self.known.update((p, len(encoding.encode_ordinary(p))) for p in new)
        known = self.known
        return sum(known[p] * n for p, n in pieces.items())

    def count(self, text: str | None) -> int:
        return self.counts(Counter(self._split(text))) if text else 0


def token_counts(documents: DataFrame, tokenizers: list[str], path: str | None = None) -> DataFrame:
    """``doc_id`` and a map of tokenizer name to the text's number of tokens; 0 for null and empty texts."""
    where = V.folder(path)
    df = spread(documents.select("doc_id", "text"), "doc_id")

    def run(batches):
        counters = {t: TokenCounter(t, where) for t in tokenizers}
        byte_level = [c for c in counters.values() if not c.word]
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = {}
                if text and byte_level:
                    pieces = Counter(byte_level[0]._split(text))
                    found = {c.name: c.counts(pieces) for c in byte_level}
                rows.append([found[t] if t in found else c.count(text) for t, c in counters.items()])
            yield pd.DataFrame({"doc_id": batch["doc_id"], **{f"n{i}": pd.Series([r[i] for r in rows], dtype="int64") for i in range(len(tokenizers))}})

    kind = df.schema["doc_id"].dataType.simpleString()
    counted = df.mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"n{i} bigint" for i in range(len(tokenizers))))
    return counted.select("doc_id", F.create_map(*[x for i, t in enumerate(tokenizers) for x in (F.lit(t), F.col(f"n{i}"))]).alias("tokens"))


def best_window(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """The multiset of sizes, at most ``counts`` of each, whose sum is the largest that fits ``room``; sizes in descending order.

    Bit s of ``reached`` says that some multiset sums to s. Counts are split into powers of two, so a size with a million documents takes
    a few shifts; the search ends as soon as the room is filled exactly. Backtracking walks the stored bitsets.
    """
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for size, count in zip(sizes, counts):
        if size > room or not count:
            continue
        left, power = min(count, room // size), 1
        while left:
            take = min(power, left)
            steps.append((size, take, reached))
            reached |= (reached << (size * take)) & mask
            left -= take
            power *= 2
        if reached >> room & 1:
            break
    total, chosen = reached.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[size] = chosen.get(size, 0) + take
            total -= size * take
    return chosen


def plan_windows(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns and how often each is used, until every size is used up. ``histogram``: size (1..capacity) to count."""
    left, plan = {s: n for s, n in histogram.items() if n}, []
    while left:
        order = sorted(left, reverse=True)
        largest = order[0]
        counts = [left[s] - (s == largest) for s in order]
        pattern = best_window(order, counts, capacity - largest)
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(left[s] // m for s, m in pattern.items())
        plan.append((pattern, times))
        for s, m in pattern.items():
            left[s] -= m * times
            if not left[s]:
                del left[s]
    return plan


def _plan_group(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    capacity, base, rows, used = int(group["capacity"].iloc[0]), 0, [], Counter()
    for pattern, times in plan_windows(dict(zip(group["size"].astype(int), group["n"].astype(int))), capacity):
        for size, many in pattern.items():
            rows.append((key[0], size, used[size], many, base))
            used[size] += many * times
        base += times
    return pd.DataFrame(rows, columns=["limit_id", "size", "first", "many", "base"])


def pack(documents: DataFrame, limits: DataFrame, path: str | None = None, salts: int | None = None) -> DataFrame:
    """Containers of documents for every row of ``limits`` (limit_id, tokenizer, capacity).

    Columns: limit_id, doc_id, piece, tokens, container. A document within the capacity is one row with piece 0 and is never divided; a longer
    one is cut into full pieces of ``capacity`` tokens and a remainder, each a row. Container numbers start at 0 within a limit. Null and
    empty texts have 0 tokens and go to container 0, where they take no room. Repeated rows are packed each on their own.
    ``limits`` is a list of settings: its rows are read by the driver and stand in the plan.
    """
    settings = limits.where("tokenizer is not null and capacity > 0").select("limit_id", "tokenizer", "capacity").collect()
    names = sorted({r["tokenizer"] for r in settings})
    if not names:
        return documents.sparkSession.createDataFrame([], "limit_id int, doc_id bigint, piece int, tokens int, container bigint")
    counted = materialize(token_counts(documents, names, path), "token-counts")
    salts = salts or max(64, counted.count() // PER_SALT)
    wanted = [F.struct(F.lit(r["limit_id"]).cast("int").alias("limit_id"), F.lit(r["capacity"]).cast("long").alias("capacity"), F.col("tokens")[r["tokenizer"]].alias("tokens")) for r in settings]
    items = (
        counted.select("doc_id", F.inline(F.array(*wanted)))
        .select("limit_id", "capacity", "doc_id", "tokens", F.explode(F.expr("sequence(0, greatest(0, int((tokens - 1) div capacity)))")).alias("piece"))
        .select("limit_id", "capacity", "doc_id", "piece", F.expr("int(least(capacity, tokens - piece * capacity))").alias("size"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    )
    tally = items.where("size > 0").groupBy("limit_id", "capacity", "size", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("limit_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tally.select("limit_id", "size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    histogram = tally.groupBy("limit_id", "capacity", "size").agg(F.sum("n").alias("n"))
    # limits are planned apart, each in a task of its own
    plan = (
        histogram.repartition(16 * len(settings), "limit_id")
        .groupBy("limit_id")
        .applyInPandas(_plan_group, "limit_id int, size int, first bigint, many bigint, base bigint")
        .groupBy("limit_id", "size")
        .agg(F.array_sort(F.collect_list(F.struct("first", "many", "base"))).alias("segments"))
    )
    within = Window.partitionBy("limit_id", "size", "salt").orderBy("doc_id", "piece")
    numbered = items.where("size > 0").withColumn("number", F.row_number().over(within) - 1).join(offsets, ["limit_id", "size", "salt"]).withColumn("number", F.col("number") + F.col("offset"))
    # at most `capacity` rows a limit, each with its segments: bounded by the settings, not by the documents
    placed = (
        numbered.join(F.broadcast(plan), ["limit_id", "size"])
        .withColumn("at", F.expr("element_at(segments, greatest(1, size(filter(segments, s -> s.first <= number))))"))
        .select("limit_id", "doc_id", "piece", F.col("size").alias("tokens"), F.expr("at.base + (number - at.first) div at.many").alias("container"))
    )
    weightless = items.where("size = 0").select("limit_id", "doc_id", "piece", F.col("size").alias("tokens"), F.lit(0).cast("long").alias("container"))
    return placed.unionByName(weightless)


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """For every limit: containers, documents, tokens, share of the room that is filled, and the containers that could not be fewer."""
    sums = packed.groupBy("limit_id").agg(F.count_distinct("doc_id").alias("documents"), F.sum("tokens").cast("long").alias("tokens"), (F.max("container") + 1).alias("containers"))
    return (
        F.broadcast(limits.select("limit_id", "tokenizer", "capacity"))
        .join(sums, "limit_id", "left")
        .select("limit_id", "tokenizer", "capacity", "documents", "tokens", "containers", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))
    )
