"""Problem 1: cut texts longer than a limit at natural boundaries, with a fixed overlap.

A text is first broken into atomic segments: sentences and lines, or the words of a sentence that can't fit a chunk, or slices of a word that
can't. All boundaries between neighbours wait in a heap, weakest first (inside a word, between words, after a clause, after a sentence, at a
line end, before a list item or table row, between paragraphs, before a heading). The weakest is merged away while the combined piece plus
the overlap still fits, so what remains are the strongest boundaries. Each text is handled on its own inside its partition.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import spread

SLICE, WORD, CLAUSE, SENTENCE, LINE, ITEM, PARAGRAPH, HEADING = range(8)
#: Ends of sentences: a mark, closing brackets or quotes, then a blank; or a full-width mark, which needs none. Line ends without one are soft wraps.
_SENTENCE = re.compile(r"""[.!?…]["'”’)\]]*(?=\s)|[。！？]["'”’」』)\]]*""")
_CLAUSE = re.compile(r"[,;:、，；：]$")
_STRETCH = re.compile(r"[^\s。]+")
#: A line that ends where it ends: heading, list item, table row, quotation, code fence.
_MARKED = re.compile(r"\s*(?:#|[-*+•|>]|\d+[.)]\s|```)")
_ITEM = re.compile(r"\s*(?:[-*+•|>]|\d+[.)]\s|```)")


def _sentences(text: str) -> list[tuple[int, int]]:
    """(end, strength of the boundary there) of every sentence or line; blanks belong to what they follow."""
    ends: dict[int, int] = {}
    for m in _SENTENCE.finditer(text):
        end = m.end()
        while end < len(text) and text[end].isspace() and text[end] != "\n":
            end += 1
        ends[end] = SENTENCE
    for m in re.finditer(r"\n\s*", text):
        end, after = m.end(), text[m.end() : m.end() + 4]
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        found = HEADING if after.startswith("#") else PARAGRAPH if m[0].count("\n") > 1 else ITEM if _ITEM.match(after) else LINE if _MARKED.match(line) else 0
        if ends.get(m.start()):
            found = max(found, LINE)
        if found:  # other line ends are soft wraps inside a sentence
            ends.pop(m.start(), None)
            ends[end] = max(found, ends.get(end, 0))
    ends.pop(0, None)
    ends[len(text)] = HEADING
    return sorted(ends.items())


def atoms(text: str, room: int) -> tuple[list[int], list[int]]:
    """Starts of the atomic segments, none longer than ``room``, and the strength of the boundary before each."""
    starts, strength, at, before = [], [], 0, HEADING
    for end, after in _sentences(text):
        if end - at <= room:
            starts.append(at)
            strength.append(before)
        else:
            first = True
            for m in re.finditer(r"\s*\S+\s*?(?=\s|$)|\s+", text[at:end]):
                a, b = at + m.start(), at + m.end()
                if b - a > room and (lead := len(m[0]) - len(m[0].lstrip())):
                    # blanks before a word that must be sliced stand on their own, so that the word starts a slice
                    starts.append(a)
                    strength.append(before if first else WORD)
                    first, a = False, a + lead
                for k in range(a, b, room):
                    starts.append(k)
                    strength.append(before if first else SLICE if k > a else CLAUSE if _CLAUSE.search(text[max(0, k - 1) : k]) else WORD)
                    first = False
        at, before = end, after
    return starts, strength


def split(text: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces of a text as (start, end, strength of the boundary at start); consecutive pieces share ``overlap`` characters.

    A text of at most ``size`` characters is one piece. The overlap is less than the size, as asked for; every piece keeps within the size.
    """
    if len(text) <= size:
        return [(0, len(text), HEADING)]
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    room = size - overlap
    starts, strength = atoms(text, room)
    n = len(starts)
    ends = [*starts[1:], len(text)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    gone = [False] * n
    heap = [(strength[i], ends[i] - starts[i - 1], i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, length, i = heapq.heappop(heap)
        if gone[i]:
            continue
        k = left[i]
        now = ends[i] - starts[k]
        if now != length:
            # the pair has grown since: back in line by its length, unless it can't fit any more
            if now + (overlap if starts[k] else 0) <= size:
                heapq.heappush(heap, (strength[i], now, i))
            continue
        if now + (overlap if starts[k] else 0) > size:
            continue
        ends[k], gone[i], right[k] = ends[i], True, right[i]
        if right[k] < n:
            left[right[k]] = k
    kept = [i for i in range(n) if not gone[i]]
    return [(max(0, starts[i] - overlap) if starts[i] else 0, ends[i], strength[i]) for i in kept]


def longest_stretch(text: str) -> int:
    """Length of the longest run without white space and without the ideographic full stop."""
    return max((len(m) for m in _STRETCH.findall(text)), default=0)


def split_texts(rows: DataFrame, sizes: DataFrame, key: str = "page_id", text: str = "markdown", config: str = "config_id") -> DataFrame:
    """Pieces of every text, by the chunk_size and chunk_overlap of its configuration.

    Columns: ``key``, piece (from 0), start, chars, strength (of the boundary at its start), chunk, stretch (of the whole text, see
    ``longest_stretch``), size (the limit that applied), over (whether the text exceeds it). Texts within the size are one piece. Null and empty texts and rows whose
    configuration is unknown, has no positive size or an overlap that isn't less than it give no piece; a negative overlap is none. Repeated rows are each cut. ``sizes`` is a small list of settings.
    """
    wanted = sizes.where("chunk_size > 0").select(F.col("config_id").alias(config), F.col("chunk_size").cast("int"), F.greatest(F.coalesce(F.col("chunk_overlap"), F.lit(0)), F.lit(0)).cast("int").alias("chunk_overlap")).where("chunk_overlap < chunk_size")
    df = spread(rows.select(F.col(key).alias("k"), F.col(text).alias("t"), config).where("t <> ''"), "k").join(F.broadcast(wanted), config).drop(config)

    def run(batches):
        for batch in batches:
            out = []
            for k, t, size, overlap in zip(batch["k"], batch["t"], batch["chunk_size"], batch["chunk_overlap"]):
                stretch, over = longest_stretch(t), len(t) > size
                out += [(k, i, a, b - a, s, t[a:b], stretch, size, over) for i, (a, b, s) in enumerate(split(t, size, overlap))]
            yield pd.DataFrame(out, columns=["k", "piece", "start", "chars", "strength", "chunk", "stretch", "size", "over"])

    kind = df.schema["k"].dataType.simpleString()
    return df.mapInPandas(run, f"k {kind}, piece int, start int, chars int, strength int, chunk string, stretch int, size int, over boolean").withColumnRenamed("k", key)
