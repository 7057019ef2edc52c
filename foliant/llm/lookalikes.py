"""Problem 2: one consistent form for text that looks the same.

Most characters are stable: they are their own canonical form wherever they stand. A quick-check class, made once from the Unicode database,
holds the others (characters that change, or that may join the one before). Texts without any are passed over by a JVM pattern; in the
others only the segments around unstable characters, from the starter before them on, are normalised and spliced back.

Folded: width of letters and blanks, no-break and other blanks, hyphen code points, ligatures, composed and decomposed accents, conjoining
jamo, invisible characters, and look-alike letters of Greek, Cyrillic, Armenian and Cherokee. Kept, since a reader sees them: case, accents, line breaks,
raised, circled or other figures, dashes, symbols.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import materialize

#: Letters of other scripts that are drawn as the Latin letter beside them.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "ɡ": "g",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "զ": "q", "Օ": "O", "Տ": "S", "Ս": "U",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
}
#: Hyphen code points drawn as the ASCII one, and invisible code points outside category Cf.
HYPHENS = "‐‑﹣"
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ"


@functools.cache
def simple_map() -> dict[int, str]:
    """Code point to what it is drawn as, where that doesn't depend on its neighbours. Made by rule from the Unicode database."""
    found: dict[int, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        kind, parts = unicodedata.category(c), unicodedata.decomposition(c).split()
        tag = parts[0] if parts and parts[0][0] == "<" else ""
        if kind == "Zs":
            found[cp] = " "
        elif kind == "Cf" and cp not in (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F, 0x8E2) or c in INVISIBLE or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            found[cp] = ""
        elif tag in ("<wide>", "<narrow>"):
            found[cp] = unicodedata.normalize("NFKC", c)
        elif tag == "<compat>" and ("LIGATURE" in unicodedata.name(c, "") and (0xFB00 <= cp <= 0xFB17 or cp in (0x132, 0x133)) or 0x1C4 <= cp <= 0x1CC or 0x1F1 <= cp <= 0x1F3):
            found[cp] = "".join(chr(int(x, 16)) for x in parts[1:]).replace("ſ", "s")
    found |= {ord(c): "-" for c in HYPHENS}
    return found


#: Ranges without any unstable character, as a Java and Python class: a text of these alone is passed over in the JVM. Few ranges, so the
#: test costs little a character; whatever else a text holds, the exact class decides.
STABLE = "\x00-\x7F\u00C0-\u0131\u0134-\u017F가-힣ぁ-ゖァ-ー一-鿋、。・「」–—•·²³¹①-⑳"


_MAYBE = re.compile(f"[^{STABLE}]")
_LETTER = re.compile(r"[^\W\d_]")


@functools.cache
def unstable_class() -> str:
    """A character class of every code point that fails the quick check: it changes, joins its neighbour, or is a look-alike."""
    bad = set(simple_map()) | {ord(c) for c in LOOKALIKES}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        c = chr(cp)
        # any letter of these scripts may share a word with letters of another script
        mixed = (0x370 <= cp <= 0x58F or 0x13A0 <= cp <= 0x13FF) and c.isalpha()
        if mixed or unicodedata.combining(c) or 0x1100 <= cp <= 0x11FF or not unicodedata.is_normalized("NFC", c):
            bad.add(cp)
    spans = []
    for cp in sorted(bad):
        if spans and spans[-1][1] == cp - 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]"


@functools.cache
def _patterns():
    bad = unstable_class()
    # a word counts as a whole for look-alikes; elsewhere a segment is the starter before the unstable run and the run itself
    return re.compile(bad), re.compile(rf"(?:[^\W\d_]|{bad})*{bad}(?:[^\W\d_]|{bad})*|.?{bad}+", re.S)


@functools.cache
def _letters():
    back = {}
    for script in ("CYRILLIC", "GREEK", "ARMENIAN", "CHEROKEE"):
        back[script] = {v: k for k, v in LOOKALIKES.items() if unicodedata.name(k).startswith(script)}
    return back


def _fold_word(word: str) -> str:
    """Look-alikes in one word: all to the other script if the word has a letter that only that script has, else to Latin.

    Accents are taken off first and put back on, so an accented look-alike folds as its letter does.
    """
    letters = unicodedata.normalize("NFD", word)
    for script, back in _letters().items():
        if any(c not in LOOKALIKES and not c.isascii() and unicodedata.name(c, "").startswith(script) for c in letters):
            return unicodedata.normalize("NFC", "".join(back.get(LOOKALIKES.get(c, c), c) for c in letters))
    return unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in letters))


#: A word with a letter of Greek, Cyrillic, Armenian, Cherokee or one of the few others that are folded.
_MARKED = r"[^\W\d_]|[\u0300-\u036f]"
_WORD = re.compile(rf"(?:{_MARKED})*[\u0370-\u058f\u13a0-\u13ff\u0261](?:{_MARKED})*")
#: Between pictographs a joiner changes the picture.
_JOINER = re.compile("(?<=[←-⯿️\U0001f000-\U0001faff])‍(?=[←-⯿\U0001f000-\U0001faff])")


def _segment(segment: str) -> str:
    kept = _JOINER.sub("", segment) if "‍" in segment else segment
    drawn = unicodedata.normalize("NFC", kept.translate(simple_map()))
    if "" in drawn:
        drawn = drawn.replace("", "‍")
    return _WORD.sub(lambda m: _fold_word(m[0]), drawn)


def canonical(text: str | None) -> str | None:
    """The consistent form of one text; null stays null, an empty text empty. Applying it again changes nothing."""
    if not text or text.isascii() or not _MAYBE.search(text):
        return text
    bad, segment = _patterns()
    if not bad.search(text):
        return text
    out, at = [], 0
    while found := bad.search(text, at):
        # the segment around an unstable character: its word, or the starter before it
        start = found.start()
        while start > at and _LETTER.match(text, start - 1):
            start -= 1
        if start == found.start() > at:
            start -= 1
        m = segment.match(text, start)
        out += [text[at:start], _segment(m[0])]
        at = m.end()
    once = "".join(out) + text[at:]
    # dropping an invisible character may bring a mark and its starter together over a segment's end
    return once if unicodedata.is_normalized("NFC", once) else unicodedata.normalize("NFC", once)


def may_be_unstable(text: Column) -> Column:
    """Whether the text holds a character outside the stable ranges; evaluated in the JVM, in one pass without going back."""
    return (F.octet_length(text) != F.length(text)) & ~text.rlike(f"^[{STABLE}]*+\\z")


def normalize_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text`` in its consistent form and whether it ``changed``; only texts that may be unstable leave the JVM.

    Null texts stay null and empty ones empty, both unchanged; repeated rows stay repeated; other columns are dropped.
    """

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.map(canonical, na_action="ignore")

    t = F.col(text)
    folded = rows.select(key, text, fold(F.when(may_be_unstable(t), t)).alias("__folded"))
    return folded.select(key, F.coalesce("__folded", t).alias(text), (F.coalesce(F.col("__folded") != t, F.lit(False))).alias("changed"))


def lookalike_pairs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of keys (``id_a`` < ``id_b``) whose texts are not blank, share one consistent form and differ as stored.

    Null, empty and blank texts (nothing visible) give no pair; equal strings neither, so copies aren't paired among themselves: the stored
    variants of a form are paired first, from counts, and only variants that have a counterpart are joined to their rows. A repeated key
    is no pair with itself.
    """

    import xxhash

    def signed(data: bytes) -> int:
        h = xxhash.xxh64_intdigest(data, 42)
        return h - (1 << 64) if h >> 63 else h

    @F.pandas_udf("a bigint, b bigint, blank boolean")
    def form(values: pd.Series) -> pd.DataFrame:
        def digest(t):
            if t is None:
                return None, None, None
            drawn = canonical(t)
            return signed(drawn.encode("utf-8", "surrogatepass")), signed(drawn[::-1].encode("utf-8", "surrogatepass")), not drawn.strip()

        found = list(zip(*[digest(t) for t in values])) or [(), (), ()]
        # whole numbers beside nulls: never by way of floats
        return pd.DataFrame({"a": pd.array(found[0], "Int64"), "b": pd.array(found[1], "Int64"), "blank": pd.array(found[2], "boolean")})

    # 128 bits of a text, forwards and backwards, as two numbers: these are grouped and joined without sorting binaries
    t = F.col(text)
    stored = F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.reverse(t)).alias("b"))
    read = rows.where(t.rlike("\\S")).select(F.col(key).alias("id"), stored.alias("s"), form(F.when(may_be_unstable(t), t)).alias("f"))
    hashed = read.where(~F.coalesce("f.blank", F.lit(False))).select("id", F.col("s.a").alias("s1"), F.col("s.b").alias("s2"), F.coalesce("f.a", "s.a").alias("f1"), F.coalesce("f.b", "s.b").alias("f2"))
    hashed = materialize(hashed, "lookalike-forms")
    # variants first: only forms with several are joined, whatever number of copies each variant has
    variants = hashed.groupBy("f1", "f2", "s1", "s2").agg(F.lit(1).alias("one"))
    many = variants.groupBy("f1", "f2").agg(F.count("*").alias("n")).where("n > 1").select("f1", "f2")
    kept = materialize(hashed.join(many, ["f1", "f2"], "left_semi"), "lookalike-rows")
    some = kept.select("f1", "f2", "s1", "s2").distinct()
    x, y = some.alias("x"), some.alias("y")
    pairs = x.join(y, (F.col("x.f1") == F.col("y.f1")) & (F.col("x.f2") == F.col("y.f2")) & ((F.col("x.s1") < F.col("y.s1")) | ((F.col("x.s1") == F.col("y.s1")) & (F.col("x.s2") < F.col("y.s2")))))
    pairs = pairs.select("x.f1", "x.f2", "x.s1", "x.s2", F.col("y.s1").alias("u1"), F.col("y.s2").alias("u2"))
    left, right = kept.withColumnRenamed("id", "i"), kept.select("f1", "f2", F.col("s1").alias("u1"), F.col("s2").alias("u2"), F.col("id").alias("j"))
    both = pairs.join(left, ["f1", "f2", "s1", "s2"]).join(right, ["f1", "f2", "u1", "u2"]).where("i <> j")
    return both.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()
