import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import lookalikes as L

SAME = [
    ("ＡＢＣ　１２", "ABC 12"), ("ﬁne ﬀ", "fine ff"), ("café", "café"), ("한", "한"), ("a​b­c", "abc"), ("a b c d", "a b c d"), ("co‐op x‑y", "co-op x-y"),
    ("Мarko рlаn", "Marko plan"), ("prосѐѕ", "procès"), ("ｻﾎﾟｰﾄ", "サポート"), ("﻿text", "text"), ("Νοte", "Note"),
]
OTHER = ["²", "2", "②", "③", "Text", "text", "resume", "résumé", "a\nb", "a b", "–", "-", "Привет", "ⅷ", "½", "٣"]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert L.canonical(a) == L.canonical(b) == b


def test_different_stay_different():
    assert len({L.canonical(x) for x in OTHER}) == len(OTHER)


def test_script_of_the_word_decides():
    assert L.canonical("Привет") == L.canonical("Пpивeт") == "Привет"


def test_stable_ranges_hold_no_unstable_character():
    stable, unstable = re.compile(f"[{L.STABLE}]"), re.compile(L.unstable_class())
    assert not [c for c in map(chr, (i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF)) if stable.match(c) and unstable.match(c)]


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="aeоаеνΑéе́̈​­ １Ａ가각ﬁѐ-‐\n", max_size=40))
def test_idempotent_and_composed(text):
    once = L.canonical(text)
    assert L.canonical(once) == once and unicodedata.is_normalized("NFC", once)


def test_pairs(spark):
    rows = [(1, "Νοte one"), (2, "Note one"), (3, "Note one"), (4, "other"), (5, None), (6, ""), (7, "​"), (8, " "), (9, "Note one"), (10, "note one")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k long, t string, form string")
    got = {(r.id_a, r.id_b) for r in L.lookalike_pairs(df, "k", "t").collect()}
    assert got == {(1, 2), (1, 3), (1, 9), (2, 9), (3, 9)}
    # copies make no pairs however many there are
    many = spark.range(20_000).selectExpr("id AS k", "'same text' AS t")
    assert L.lookalike_pairs(many, "k", "t").count() == 0 and L.lookalike_pairs(df.limit(0), "k", "t").count() == 0
    folded = {r.k: (r.t, r.changed) for r in L.normalize_texts(df, "k", "t").collect()}
    assert folded[1] == ("Note one", True) and folded[2] == ("Note one", False) and folded[5] == (None, False) and folded[6] == ("", False)


def test_other_scripts():
    assert L.canonical("Ꮯompany") == "Company" and L.canonical("hօuse") == "house"
    # a word of its own script stays, look-alikes in it too
    for word in ("ᏣᎳᎩ", "հայոց", "Տուն"):
        assert L.canonical(word) == word and L.canonical(L.canonical(word)) == word


def test_long_stable_words_cost_little():
    import time

    from foliant.llm.lookalikes import _patterns, _segment, canonical

    canonical("а ́")
    began = time.process_time()
    assert canonical("a" * 40_000 + " pаy") == "a" * 40_000 + " pay"
    assert time.process_time() - began < 0.5
    # the segments are those that a search from the left finds
    for text in ("x́ý 1́ab́", ".́́aеb", "​​á", "á.́b1е", "각x ａ"):
        assert canonical(text) == _patterns()[1].sub(lambda m: _segment(m[0]), text)
