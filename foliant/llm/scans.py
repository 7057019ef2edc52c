"""Problem 4: text from scanned pages back into continuous, readable paragraphs.

The words of a paragraph are decoded jointly over its character stream with the line ends taken out: a noisy-channel search (Viterbi over the
word lattice) may keep a word, read it with some recognition confusions undone, join two pieces across a line end (with or without a
hyphen) or a blank, or split a piece in two; joined and split pieces may have confusions undone too. A word costs its surprise in a lexicon of
the corpus, every undone confusion, join and split costs a constant. Noise is what the cheapest path goes through. Which line ends are
paragraph ends is chosen by dynamic programming over the lines. Where no edge over two pieces is cheaper than the pieces alone, the cheapest
path is each piece's best reading, so only texts with such an edge or a hyphen at a line end need the search. Running lines and page numbers come from the
document's other pages (``edges``) and are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import edges
from foliant.llm.lexicon import WORD, Lexicon, form, lexicon
from foliant.llm.lookalikes import canonical
from foliant.session import materialize, spread

#: What is printed and what it was read for (seen, meant).
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("5", "s"), ("@", "a"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("c", "e"), ("e", "c"), ("f", "t"), ("l", "i"),
    ("ri", "n"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("rn", "m"), ("vv", "w"), ("m", "rn"), ("m", "in"), ("d", "cl"),
    ("논", "는"), ("온", "은"), ("외", "의"), ("률", "를"), ("애", "에"), ("퇴", "되"), ("율", "을"), ("늘", "는"),
)
#: Kanji read for katakana between katakana, and the figures that letters are read for.
KANA = {"一": "ー", "力": "カ", "口": "ロ", "二": "ニ", "工": "エ", "夕": "タ", "卜": "ト", "八": "ハ", "才": "オ"}
FIGURES = str.maketrans("OoIlZSbB|", "001125681")
CONFUSED, CONFUSED_SYLLABLE, FIGURED, JOINED, SPLIT, UNKNOWN = 3.0, 2.0, 0.5, 1.0, 3.0, 3.0
#: What a blank inside a word costs more if both pieces are words by themselves.
APART = 6.0

#: What a letter adds to a word's sum: no confusion changes a sum, so a word whose sum no lexicon word has can't be misread from one.
_UNITS = {"n": "ii", "h": "ii", "u": "ii", "m": "iii", "d": "ci", "w": "vv"} | dict(zip("0lr1|5@9683ef논늘온외률애퇴율", "oiiiisagbbcct는는은의를에되을"))


_MASK = (1 << 64) - 1


@functools.cache
def _unit(letter: str) -> int:
    if letter in _UNITS:
        return sum(_unit(c) for c in _UNITS[letter])
    return int.from_bytes(hashlib.blake2b(letter.encode("utf-8", "surrogatepass"), digest_size=7).digest())


def letter_sum(word: str) -> int:
    return sum(map(_unit, word))


_BY_SEEN: dict[str, list[str]] = {}
for _seen, _meant in CONFUSIONS:
    _BY_SEEN.setdefault(_seen, []).append(_meant)
_ANY_SEEN = re.compile("|".join(sorted(map(re.escape, _BY_SEEN), key=len, reverse=True)))
_NUMBER = re.compile(r"(?=[^\d]*\d)(?=[\d.,]*[OoIlZSbB|])[\dOIlZSbB|o]+(?:[.,][\dOIlZSbB|o]+)*")
#: A number with a Korean or Japanese counter.
_COUNTED = re.compile(r"([제第]?)((?=[^\d가-힣]*\d)(?=[\d.,]*[OoIlZSbB|])[\dOoIlZSbB|.,]+)([가-힣一-鿿ぁ-ヺ][가-힣一-鿿ぁ-ヺー]*)")
_FIGURED_WORD = re.compile(r"[^\W\d_]{2,}[0-9@|][^\W\d_]+|[^\W\d_]+[0-9@|][^\W\d_]{2,}|[^\W\d_]{4,}[015@|]")
_ANY_FIGURE = re.compile(r"\d")
_ROMAN = re.compile(r"[ivxlc]+")
_CODE = re.compile(r"[A-Za-z]{1,4}-\w*\d\w*|\w*\d\w*-\w+|.*[A-Z].*[a-z].*[A-Z].*")
_KANA = re.compile(r"(?<=[ァ-ヺー])[一力口二工夕卜八才](?=[ァ-ヺー])|(?<=[ァ-ヺ])[一](?=[^一-鿿])")
_BROKEN_OFF = re.compile(r"([^\W\d_][\w'’@|-]*?)([-¬])$")
_BROKEN_REST = re.compile(r"[^\W\d_][\w'’@|]*(?:-\w+)*")
_MARKED = re.compile(r"\s*(?:#|[-*+•>]\s|\||\d+[.)]\s)")
#: Inline code by what must stand in a text that holds it; the last kind is looked for beside any other.
_INLINE = (("`", r"`[^`\n]*`"), ("<", r"<[^<>\n]{1,40}>"), ("://", r"https?://\S+"), ("--", r"--[\w-]+"), ("_", r"\b\w+_\w+\b"), ("", r"(?<=[a-z])\.\w+(?=[ (=])"))
_SENTENCE_END = re.compile(r"[.!?。:][\"'”’)\]]*\s*$")
_HYPHENED = re.compile(r"[^\W\d_][-¬]\s*$")
_CLOSED = re.compile(r"[.!?。|`:;)\]\"'”’]\s*$")
#: Figures that don't stand inside a word.
_OWN_FIGURES = re.compile(r"(?<![^\W_])\d[\d.,:]*")
_CODED_FENCE = re.compile(r"^[ \t]*(?:```|~~~)(?!markdown|md|[ \t]*$)\w+[ \t]*\n.*?(?:^[ \t]*(?:```|~~~)[ \t]*$|\Z)", re.S | re.M)


@functools.cache
def _inline(held: tuple[str, ...]) -> re.Pattern:
    """Inline code of the kinds that a text with these marks can hold; the others could match nowhere."""
    return re.compile("|".join(pattern for mark, pattern in _INLINE if mark in held))


class Decoder:
    """Word decoding with one lexicon; verdicts on single words are remembered."""

    def __init__(self, words: Lexicon, keep: int = 500_000):
        self.words, self.keep = words, keep
        self.log_total = math.log(max(2, words.total))
        self.sums = {letter_sum(w) for w in words.times}
        self.sorted_sums = np.sort(np.fromiter((x & _MASK for x in self.sums), np.uint64, len(self.sums)))
        #: No confusion changes a word's length by more than one, and at most two are undone: longer words can't be read as a lexicon word.
        self.longest = max(map(len, words.times), default=0) + 2
        self.known: dict[str, str | None] = {}
        self.chunks: dict[str, bool] = {}
        self.readings: dict[str, tuple[str, float, bool]] = {}
        self.plain: set[tuple[str, str]] = set()
        self.edges: dict[tuple[str, bool], tuple | None] = {}
        self.forget()

    def forget(self) -> None:
        """Empties what is known of stretches without blanks: number, sums of the words at either end (0 for none), whether one is misread."""
        self.numbers: dict[str, int] = {}
        self.tails, self.heads, self.misread = np.zeros(1024, np.uint64), np.zeros(1024, np.uint64), np.zeros(1024, bool)

    def cost(self, word: str) -> float:
        n = self.words.times.get(word if word.isalpha() and word.islower() else form(word))
        return self.log_total - math.log(n) if n else self.log_total + UNKNOWN

    def _undo(self, word: str) -> list[tuple[str, float]]:
        """The word with one confusion undone, in every way."""
        out = []
        for m in _ANY_SEEN.finditer(word):
            for seen in {m[0], m[0][0]} & _BY_SEEN.keys():
                for meant in _BY_SEEN[seen]:
                    cost = CONFUSED_SYLLABLE if seen > "가" else CONFUSED if seen.isalpha() else FIGURED
                    out.append((word[: m.start()] + meant + word[m.start() + len(seen) :], cost))
        return out

    def read(self, word: str) -> tuple[str, float, bool]:
        """Best reading of one lower-case word: the reading, its cost, whether confusions were undone."""
        best, low, changed = word, self.cost(word), False
        # of two letters too much is a word, a unit or a piece
        if len(word) < 2 or len(word) > self.longest or (len(word) == 2 and word.isalpha() and word < "가") or word.isdigit() or _ROMAN.fullmatch(word):
            return best, low, False
        # figures that stay are written alike in the lexicon, so sums tell nothing about them
        first = self._undo(word) if _ANY_FIGURE.search(word) or letter_sum(word) in self.sums else []
        for w, c in first:
            if form(w) in self.words and (total := self.cost(w) + c) < low:
                best, low, changed = w, total, True
        if not changed and len(word) >= 5 and form(word) not in self.words:
            for w1, c1 in first:
                for w, c in self._undo(w1):
                    if form(w) in self.words and (total := self.cost(w) + c + c1) < low:
                        best, low, changed = w, total, True
        if not changed and form(word) not in self.words and _FIGURED_WORD.fullmatch(word) and max(word) < "ぁ":
            # a rare name with one figure inside can't be looked up, but no word is written so, except where words aren't set apart
            w = _ANY_SEEN.sub(lambda m: _BY_SEEN[m[0]][0] if not m[0].isalpha() else m[0], word)
            if w.isalpha():
                best, low, changed = w, low - 1, True
        return best, low, changed

    def correction(self, token: str) -> str | None:
        """What a token of the text was meant to be, or None if it is fine."""
        found = self.known.get(token, "")
        if found != "":
            return found
        if len(self.known) > self.keep:
            self.known.clear()
        found = None
        if _NUMBER.fullmatch(token):
            found = token.translate(FIGURES)
        elif m := _COUNTED.fullmatch(token):
            found = m[1] + m[2].translate(FIGURES) + m[3]
        elif not _CODE.fullmatch(token) and not token.isdigit() and (token[1:] == token[1:].lower() or token.isupper() and len(token) > 3):
            if _KANA.search(token):
                found = _KANA.sub(lambda m: KANA[m[0]], token)
            else:
                best, _, changed = self.read(token.lower())
                if changed:
                    found = best.upper() if token.isupper() and len(token) > 1 else best[:1].upper() + best[1:] if token[0].isupper() else best
        self.known[token] = found
        return found

    def best(self, word: str) -> tuple[str, float, bool]:
        """One word of the text as it stands, with confusions undone or split in two, whichever is cheapest: the reading, its cost, whether
        confusions were undone."""
        low = word.lower()
        found = (word, self.cost(low), False)
        if (fixed := self.correction(word)) is not None:
            # what no writer writes is read otherwise whatever the lexicon holds
            meant, cost, changed = self.read(low)
            found = (fixed, cost if changed and meant == fixed.lower() else found[1] - 1, True)
        if word.isalpha() and len(word) <= 2 * self.longest and form(low) not in self.words:
            for k in range(2, len(word) - 1):
                a, b = low[:k], low[k:]
                if form(a) in self.words:
                    x, y = (a, self.cost(a), False), self.read(b) if self.cost(a) + SPLIT < found[1] else (b, math.inf, False)
                elif form(b) in self.words:
                    x, y = self.read(a) if self.cost(b) + SPLIT < found[1] else (a, math.inf, False), (b, self.cost(b), False)
                else:
                    continue
                if x[1] + y[1] + SPLIT < found[1] and form(x[0]) in self.words and form(y[0]) in self.words:
                    parts = [self._cased(h, r[0]) if r[2] else h for h, r in ((word[:k], x), (word[k:], y))]
                    found = (" ".join(parts), x[1] + y[1] + SPLIT, x[2] or y[2])
        return found

    @staticmethod
    def _cased(seen: str, meant: str) -> str:
        return meant.upper() if seen.isupper() and len(seen) > 1 else meant[:1].upper() + meant[1:] if seen[:1].isupper() else meant

    def alone(self, chunk: str) -> tuple[str, float, bool]:
        """The cheapest reading of a stretch without blanks by itself, over all its words; remembered."""
        found = self.readings.get(chunk)
        if found is None:
            if len(self.readings) > self.keep:
                self.readings.clear()
            out, at, cost, changed = [], 0, 0.0, False
            for m in WORD.finditer(chunk):
                r = self.best(m[0])
                out += [chunk[at : m.start()], r[0]]
                at, cost, changed = m.end(), cost + r[1], changed or r[2]
            found = self.readings[chunk] = ("".join(out) + chunk[at:], cost, changed)
        return found

    def last(self, chunk: str) -> tuple[str, float, bool]:
        """The reading of a text's last chunk, where its last word may be cut off: then a word that others begin with stands, and
        a single confusion or figures are undone, but not more."""
        words = list(WORD.finditer(chunk))
        if not words or words[-1].end() < len(chunk):
            return self.alone(chunk)
        word = words[-1][0]
        head, low = self.alone(chunk[: words[-1].start()]), word.lower()
        found = self.best(word)
        if found[2] and low.isalpha() and not _KANA.search(word):
            whole = found[0].lower()
            if form(whole) not in self.words or whole not in {w for w, _ in self._undo(low)} or self.words.begins(low):
                found = (word, self.cost(low), False)
        return head[0] + found[0], head[1] + found[1], head[2] or found[2]

    def edge_word(self, chunk: str, at_end: bool) -> tuple | None:
        """The word that a stretch ends (or begins) with: the word, lower case, its cost alone, whether it is in the lexicon, its sum, and the
        reading of the rest. None if the stretch has other characters there; remembered."""
        found = self.edges.get((chunk, at_end), 0)
        if found == 0:
            if len(self.edges) > self.keep:
                self.edges.clear()
            words = list(WORD.finditer(chunk))
            m = words[-1 if at_end else 0] if words else None
            if m is None or (m.end() < len(chunk) if at_end else m.start()) or len(m[0]) > self.longest or not m[0][0 if at_end else -1].isalpha():
                found = None
            else:
                low = m[0].lower()
                found = (m[0], low, self.best(m[0])[1], form(low) in self.words, letter_sum(low), self.alone(chunk[: m.start()] if at_end else chunk[m.end() :]))
            self.edges[chunk, at_end] = found
        return found

    def merged(self, left: str, right: str) -> tuple[str, float, bool] | None:
        """Two stretches read as one word across a blank, if that is cheaper than reading them alone."""
        a, b = self.edge_word(left, True), self.edge_word(right, False)
        # a joined word is a lexicon word, with confusions undone or not
        if a is None or b is None or a[4] + b[4] not in self.sums or b[0][0].isupper() and not a[0].isupper():
            return None
        meant, cost, changed = self.read(a[1] + b[1])
        cost += JOINED + (APART if a[3] and b[3] else 0.0)
        if form(meant) not in self.words or cost >= a[2] + b[2]:
            return None
        shown, head, tail = self._cased(a[0] + b[0], meant) if changed else a[0] + b[0], a[5], b[5]
        return head[0] + shown + tail[0], head[1] + cost + tail[1], changed or head[2] or tail[2]

    def over_line_end(self, left: str, right: str) -> list[tuple[str, float, bool, bool]]:
        """The readings of two stretches around a hyphen at a line end: reading, cost, whether the mark is dropped, whether confusions were undone."""
        m, n = _BROKEN_OFF.search(left), _BROKEN_REST.match(right)
        if m is None or n is None:
            return []
        mark, a, b = m[2], m[1].lower(), n[0].lower()
        whole, apart = self.read(a + b), self.read(a + "-" + b)
        kept = m[1] + "-" + n[0]
        out = [(self._cased(m[1] + n[0], whole[0]) if whole[2] else m[1] + n[0], whole[1], True, whole[2])]
        if mark == "-":
            # a compound's tail may itself go on, and its head may be a compound's tail
            if form(a + "-" + b) in self.words:
                out.append((kept, apart[1] - JOINED, False, apart[2]))
            if form(whole[0]) not in self.words:
                if n[0][0].isupper() or "-" in m[1]:
                    out.append((kept, whole[1] - 1, False, False))
                if form(a) in self.words and form(b) in self.words and len(a) > 3 and len(b) > 3:
                    out.append((kept, self.cost(a) + self.cost(b) - 0.2 * self.log_total + UNKNOWN, False, False))
        head, tail = self.alone(left[: m.start()]), self.alone(right[n.end() :])
        return [(head[0] + r + tail[0], c + head[1] + tail[1], d, ch or head[2] or tail[2]) for r, c, d, ch in out]

    def skipped(self, text: str) -> str:
        """The text without program code and inline code."""
        if "```" in text or "~~~" in text:
            text = _CODED_FENCE.sub("\n", text)
        if "<|" in text:
            text = edges._LEFTOVER.sub("", text)
        held = tuple(mark for mark, _ in _INLINE if mark in text)
        return _inline(held).sub(" ", text) if len(held) > 1 else text

    def chunk_is_misread(self, chunk: str) -> bool:
        """Whether a stretch without blanks holds a misread word or number; remembered, figures made alike where they stand alone."""
        found = self.chunks.get(chunk)
        if found is None:
            alike = _OWN_FIGURES.sub("0", chunk)
            found = self.chunks.get(alike)
            if found is None:
                if len(self.chunks) > self.keep:
                    self.chunks.clear()
                found = self.chunks[alike] = self.alone(alike)[2]
            if alike == chunk or not chunk[0].isdigit():
                self.chunks[chunk] = found
        return found

    def kinds(self, text: str) -> tuple[bool, bool]:
        return self.kinds_of([text])[0]

    def kinds_of(self, texts: list[str]) -> list[tuple[bool, bool]]:
        """For each text: whether a word is split by a hyphen at a line end, and whether a word or number is misread.

        Where no edge over two pieces is the cheapest, every piece is read alone, which was done when it was first seen; only paragraphs with a
        hyphen at a line end or a pair that may be one word are searched.
        """
        if len(self.numbers) > self.keep:
            self.forget()
        texts = [self.skipped(canonical(t)) for t in texts]
        chunks, numbers = [t.split() for t in texts], self.numbers
        lengths = np.array([len(c) for c in chunks], np.int64)
        flat = [c for cs in chunks for c in cs]
        for c in set(flat):
            if c not in numbers:
                self._learn(c)
        seq = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(texts)), lengths)
        wrong = self.misread[seq]
        open_ = [bool(c) and not _CLOSED.search(t) for t, c in zip(texts, chunks)]
        for i in np.flatnonzero(open_):
            wrong[ends[i] - 1] = self.last(chunks[i][-1])[2]
        tails, heads = self.tails[seq[:-1]], self.heads[seq[1:]]
        pairs = np.flatnonzero((tails != 0) & (heads != 0) & (owner[:-1] == owner[1:]))
        sums = tails[pairs] + heads[pairs]
        if len(sums) and len(self.sorted_sums):
            pairs = pairs[self.sorted_sums[np.minimum(np.searchsorted(self.sorted_sums, sums), len(self.sorted_sums) - 1)] == sums]
        searched = {i for i, t in enumerate(texts) if "-\n" in t or "¬" in t or "- \n" in t or "-\t\n" in t}
        for at in pairs if len(self.sorted_sums) else ():
            i = int(owner[at])
            k = int(at - (ends[i] - lengths[i]))
            if i not in searched and self._matters(chunks[i][k], chunks[i][k + 1]):
                searched.add(i)
        any_wrong = np.zeros(len(texts), bool)
        any_wrong[owner[wrong]] = True
        return [self._searched(t, o) if i in searched else (False, bool(any_wrong[i])) for i, (t, o) in enumerate(zip(texts, open_))]

    def _learn(self, chunk: str) -> int:
        n = self.numbers[chunk] = len(self.numbers)
        if n >= len(self.misread):
            self.tails, self.heads, self.misread = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tails, self.heads, self.misread))
        self.tails[n], self.heads[n], self.misread[n] = self._edge_sum(chunk, True), self._edge_sum(chunk, False), self.chunk_is_misread(chunk)
        return n

    def _edge_sum(self, chunk: str, at_end: bool) -> int:
        """The sum of the word that a stretch ends (or begins) with, as ``edge_word`` has it, or 0."""
        words = WORD.findall(chunk)
        word = words[-1 if at_end else 0] if words else ""
        fits = word and len(word) <= self.longest and (chunk.endswith(word) if at_end else chunk.startswith(word)) and word[0 if at_end else -1].isalpha()
        return letter_sum(word.lower()) & _MASK if fits else 0

    def _matters(self, left: str, right: str) -> bool:
        """Whether two neighbouring stretches are cheaper as one word, so that it changes what is misread."""
        if (left, right) in self.plain:
            return False
        edge = self.merged(left, right)
        if edge is not None and (edge[2] or self.alone(left)[2] or self.alone(right)[2]):
            return True
        if len(self.plain) > self.keep:
            self.plain.clear()
        self.plain.add((left, right))
        return False

    def _searched(self, text: str, open_: bool) -> tuple[bool, bool]:
        """The verdicts from the chosen edges of the chosen paragraphs."""
        hyphen = misread = False
        groups = self.paragraphs(text.rstrip().split("\n"))
        for k, group in enumerate(groups):
            last = open_ and k == len(groups) - 1
            words = [w for line in group for w in line.split()]
            broken = any(line.rstrip()[-1:] in ("-", "¬") for line in group[:-1] if line.strip())
            if broken or any(self._matters(a, b) for a, b in zip(words, words[1:])):
                for _, dropped, changed in self.path(group, last):
                    hyphen, misread = hyphen or dropped, misread or changed
            elif not misread:
                misread = any(self.chunk_is_misread(w) for w in (words[:-1] if last else words)) or last and bool(words) and self.last(words[-1])[2]
        return hyphen, misread

    def path(self, lines: list[str], open_: bool = False) -> list[tuple[str, bool, bool]]:
        """One paragraph decoded: Viterbi over its pieces, where a piece may stand, be corrected, join the next or be split.

        The chosen edges: reading, whether a hyphen at a line end is dropped, whether confusions are undone. ``open_``: the last word may be cut off.
        """
        words, ends = [], set()
        for line in lines:
            words += line.split()
            ends.add(len(words) - 1)
        n = len(words)
        best, back = [0.0] + [math.inf] * n, [None] * (n + 1)
        for i, token in enumerate(words):
            ahead = i + 1 < n
            over = self.over_line_end(token, words[i + 1]) if ahead and i in ends and token[-1] in "-¬" else []
            reading, cost, changed = self.last(token) if open_ and not ahead else self.alone(token)
            # a hyphen that hangs at a line end inside a paragraph is as rare as an unknown word
            steps = [(1, reading, cost + (self.log_total + UNKNOWN if over else 0.0), False, changed)]
            steps += [(2, *e) for e in over]
            if ahead and not over and (edge := self.merged(token, words[i + 1])) is not None:
                steps.append((2, edge[0], edge[1], False, edge[2]))
            for k, reading, cost, dropped, changed in steps:
                if best[i] + cost < best[i + k]:
                    best[i + k], back[i + k] = best[i] + cost, (i, reading, dropped, changed)
        out, i = [], n
        while i:
            i, *edge = back[i]
            out.append(tuple(edge))
        return out[::-1]

    def paragraphs(self, lines: list[str]) -> list[list[str]]:
        """Lines into paragraphs, each a list of lines; a line end inside one is a soft wrap.

        Dynamic programming over the lines. A line starts a paragraph, is its second line, or goes on; what a step costs depends on both lines'
        states: a line end that ends (or doesn't end) a sentence, how full the line is, and the indent, which may change behind a paragraph's
        first line but not within; a paragraph of one full line costs more than a longer one.
        """
        if not lines:
            return []
        full = statistics.median([len(x) for x in lines if not _MARKED.match(x)] or [80])
        start, second, on = range(3)
        cost, steps = [0.0, math.inf, math.inf], []
        for a, b in zip(lines, lines[1:]):
            hard = not b.strip() or not a.strip() or _MARKED.match(b) or a.lstrip().startswith(("#", "|"))
            ended, moved = bool(_SENTENCE_END.search(a)), len(b) - len(b.lstrip()) - len(a) + len(a.lstrip())
            wrap = 50.0 if hard else (3.0 if ended and len(a) < 0.7 * full else 0.5 if ended else 0.0)
            stop = 0.0 if hard else (0.5 if ended else 3.0) + (2.0 if b[:1].islower() else 0.0) + (4.0 if _HYPHENED.search(a) else 0.0)
            short = 0.0 if hard or len(a) < 0.7 * full else 0.5
            options = (
                # (cost, from) of each state of the line b
                min((cost[start] + stop + short, start), (cost[second] + stop - (0.5 if moved > 0 and not hard else 0.0), second), (cost[on] + stop - (0.5 if moved > 0 and not hard else 0.0), on)),
                (cost[start] + wrap + (0.0 if moved <= 0 else 0.5), start),
                min((cost[second] + wrap + (1.0 if moved else 0.0), second), (cost[on] + wrap + (1.0 if moved else 0.0), on)),
            )
            cost = [c for c, _ in options]
            steps.append([k for _, k in options])
        k = cost.index(min(cost))
        starts = []
        for i in range(len(lines) - 1, -1, -1):
            if k == start:
                starts.append(i)
            if i:
                k = steps[i - 1][k]
        starts = starts[::-1]
        return [lines[i:j] for i, j in zip(starts, [*starts[1:], len(lines)])]

    def repair(self, text: str, dropped: set[str]) -> str:
        """The text as continuous paragraphs, without the lines in ``dropped``; program code stays as it is."""
        out, at, text = [], 0, canonical(text)
        for m in [*_CODED_FENCE.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            lines = [x for x in part.split("\n") if x.strip() not in dropped]
            for group in self.paragraphs(lines) if lines else []:
                stream = " ".join(x.strip() if len(group) > 1 else x.rstrip() for x in group)
                if stream.strip():
                    lead = stream[: len(stream) - len(stream.lstrip())]
                    out.append(lead + (stream.strip() if stream.lstrip().startswith(("|", "```")) else " ".join(e[0] for e in self.path(group))))
                elif out and out[-1]:
                    out.append("")
            if m:
                out.append(m[0].rstrip())
                at = m.end()
        return "\n".join(out).strip()


def decoder_of(words: Lexicon) -> Decoder:
    """The decoder of a lexicon; the tasks of one Python worker share it, since a worker unpacks what was broadcast once."""
    if "decoder" not in words.__dict__:
        words.__dict__["decoder"] = Decoder(words)
    return words.__dict__["decoder"]


def rival(words: Lexicon, word: str, times: int) -> bool:
    """Whether a word below the lexicon's share is still too frequent to be a misreading of the lexicon word that it resembles."""
    decoder = decoder_of(words)
    _, cost, changed = decoder.read(word)
    return changed and decoder.log_total - math.log(times) <= cost


def scanned_rows(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages and blocks in one form: src, row_id, pdf_path, page_num, text; rows without a visible character are left out."""
    a = pages.select(F.lit("pages").alias("src"), F.col("page_id").alias("row_id"), "pdf_path", "page_num", F.col("markdown").alias("text"))
    b = blocks.select(F.lit("blocks").alias("src"), F.col("block_key").alias("row_id"), "pdf_path", "page_num", F.col("block_content").alias("text"))
    return a.unionByName(b).where(edges.visible(F.col("text")))


def running(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Edge lines of pages and blocks with what they are (see ``edges.running_lines``)."""
    lines = edges.edge_lines(pages, "pages", "page_id", "markdown", False).unionByName(edges.edge_lines(blocks, "blocks", "block_key", "block_content", True))
    return edges.running_lines(materialize(edges.read_lines(lines), "edge-lines"))


def noise(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row for each kind of noise in each page or block: src, row_id, noise (hyphen, misread, header, page_no).

    Null, empty and blank texts have none. Repeated rows give repeated findings only under different keys. Extra columns are ignored.
    """
    rows = spread(scanned_rows(pages, blocks).select("src", "row_id", "text"), "row_id")
    sent = rows.sparkSession.sparkContext.broadcast(lexicon(rows.select("text"), rival))

    def run(batches):
        decoder = decoder_of(sent.value)
        for batch in batches:
            texts = batch["text"].tolist()
            found = [x for k in range(0, len(texts), 512) for x in decoder.kinds_of(texts[k : k + 512])]
            yield pd.DataFrame({"src": batch["src"], "row_id": batch["row_id"], "hyphen": [h for h, _ in found], "misread": [m for _, m in found]})

    flags = rows.mapInPandas(run, "src string, row_id bigint, hyphen boolean, misread boolean")
    kinds = F.filter(F.array(F.when(F.col("hyphen"), "hyphen"), F.when(F.col("misread"), "misread")), lambda x: x.isNotNull())
    words = flags.select("src", "row_id", F.explode(kinds).alias("noise"))
    lines = running(pages, blocks).where("is_header OR is_number")
    kinds = F.filter(F.array(F.when(F.col("is_header"), "header"), F.when(F.col("is_number"), "page_no")), lambda x: x.isNotNull())
    return words.unionByName(lines.select("src", "row_id", F.explode(kinds).alias("noise")).distinct())


def repaired(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """src, row_id and the text as continuous paragraphs, without running lines and page numbers; rows without visible text are left out."""
    rows = scanned_rows(pages, blocks).select("src", "row_id", "text")
    sent = rows.sparkSession.sparkContext.broadcast(lexicon(rows.select("text"), rival))
    lines = running(pages, blocks).where("is_header OR is_number").groupBy("src", "row_id").agg(F.collect_set(F.trim("line")).alias("dropped"))
    joined = rows.join(lines, ["src", "row_id"], "left")

    def run(batches):
        decoder = decoder_of(sent.value)
        for batch in batches:
            drop = [{canonical(x).strip() for x in d} if d is not None else set() for d in batch["dropped"]]
            yield pd.DataFrame({"src": batch["src"], "row_id": batch["row_id"], "text": [decoder.repair(t, d) for t, d in zip(batch["text"], drop)]})

    return joined.mapInPandas(run, "src string, row_id bigint, text string")
