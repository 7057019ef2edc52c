"""Words of a corpus with how often each occurs, begins and ends a sentence; shared by the scan repair and the truncation detector.

Only words with at least ``SHARE`` of all running words are kept, so the lexicon has at most 1/SHARE entries whatever the corpus holds: that
bound, not the data, is what lets it be sent to every executor.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import materialize

SHARE = 4e-6
LEAST = 3
#: Two confusions undone weigh as much as a word this many times as frequent.
RARER = 400
#: A word may hold letters, figures read for letters, an apostrophe, and hyphens inside.
WORD = re.compile(r"[^\W_][^\W_@|]*(?:[@'’|-][^\W_]+)*|@[^\W_]+")
_AFTER = re.compile(r"[.!?。！？]\s+(\S+)")
_HALVES = re.compile(r"[^\s-]+[-¬][ \t]*\n\s*\S+")
_ENDED = re.compile(r"[.!?。！？][\"'”’)\]]*$")
_FIGURES = re.compile(r"\d[\d.,:-]*")


def form(word: str) -> str:
    """Lower case with runs of figures made alike."""
    low = word.lower()
    return low if low.isalpha() else _FIGURES.sub("0", low)


@dataclass
class Lexicon:
    times: dict[str, int]
    ends: dict[str, int]
    starts: dict[str, int]
    total: int
    least: int

    def __contains__(self, word: str) -> bool:
        return word in self.times

    def begins(self, word: str) -> bool:
        """Whether a longer word begins so."""
        ordered = self.__dict__.get("ordered")
        if ordered is None:
            ordered = self.__dict__["ordered"] = sorted(self.times)
        i = bisect.bisect_right(ordered, word)
        return i < len(ordered) and ordered[i].startswith(word)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word``, ``times``, ``ends`` and ``starts`` over a table with one column ``text``; counted in each partition first."""

    def run(batches):
        # whole chunks between blanks are counted first, then each distinct chunk is taken apart once
        chunks, starts = Counter(), Counter()
        for batch in batches:
            for text in batch["text"]:
                text = text.lower()
                if "-\n" in text or "¬" in text:  # neither half of a word split at a line end is a word
                    text = _HALVES.sub(" ", text)
                chunks.update(text.split())
                starts.update(_AFTER.findall(text))
        out: dict[str, list[int]] = {}
        for chunk, n in chunks.items():
            if chunk[-1] in "-¬":  # half a word at a line end
                continue
            words = [form(w) for w in WORD.findall(chunk)]
            for w in words:
                out.setdefault(w, [0, 0, 0])[0] += n
            if words and _ENDED.search(chunk):
                out[words[-1]][1] += n
        for chunk, n in starts.items():
            if (m := WORD.search(chunk)) and (w := form(m[0])) in out:
                out[w][2] += n
        yield pd.DataFrame([(w, *c) for w, c in out.items()], columns=["word", "times", "ends", "starts"])

    counted = texts.mapInPandas(run, "word string, times bigint, ends bigint, starts bigint")
    return counted.groupBy("word").agg(F.sum("times").alias("times"), F.sum("ends").alias("ends"), F.sum("starts").alias("starts"))


def lexicon(texts: DataFrame, rival: Callable[[Lexicon, str, int], bool] | None = None, share: float = SHARE, least: int = LEAST) -> Lexicon:
    """The frequent words of the texts, at most 1/share of them, on the driver.

    ``rival``: looks, on the executors, at the rarer words down to 1/``RARER`` of the share and says which must be known too: sound words that
    would else pass for a misreading, however large the corpus is.
    """
    counted = materialize(word_counts(texts), "words")
    total = counted.agg(F.sum("times")).first()[0] or 0
    enough = max(least, int(total * share) + 1)
    rows = counted.where(F.col("times") >= enough).toPandas()
    words = Lexicon(*(dict(zip(rows["word"], rows[c])) for c in ("times", "ends", "starts")), total, enough)
    if rival is not None:
        sent = texts.sparkSession.sparkContext.broadcast(words)

        def look(batches):
            for batch in batches:
                yield batch[[rival(sent.value, w, n) for w, n in zip(batch["word"], batch["times"])]]

        rare = counted.where((F.col("times") < enough) & (F.col("times") >= max(least, enough // RARER)))
        for r in rare.mapInPandas(look, counted.schema).collect():
            words.times[r["word"]], words.ends[r["word"]], words.starts[r["word"]] = r["times"], r["ends"], r["starts"]
    return words
