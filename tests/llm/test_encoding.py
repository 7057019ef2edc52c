import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import encoding as E
from foliant.llm import vocabularies as V

PATH, NAME = V.folder(), "byte_bpe_50k"
PIECES = ["a", "b", "the ", "'s", "'ll", "!", "!!", "  ", "\n", " ", "가", "각나", "Ĥ", "1", "23", "ing", "é", "。", "日本", "a" * 36, "-", "=====", "\t", " ", "😀", "'"]


def whole(text):
    return V.byte_encoding(NAME, PATH).encode_ordinary(text)


def test_lookahead_is_finite_and_covers_a_small_list():
    assert E.sufficient_lookahead([("a", "b"), ("b", "c"), ("ab", "c")]) == 3
    # bc is read before ab: whether a b merges depends on what follows
    assert E.sufficient_lookahead([("b", "c"), ("a", "b")]) == 3
    assert 0 < E.lookahead_of(NAME, PATH) < 10_000


def test_stream_equals_whole():
    rng = random.Random(5)
    for _ in range(12):
        some = rng.sample(PIECES, rng.randint(1, 5))
        text = "".join(rng.choice(some) for _ in range(rng.randint(15_000, 40_000)))
        stream, ids, k, waits = E.StreamEncoder(NAME, PATH), [], 0, 0
        while k < len(text):
            n = rng.choice((1, 2, 3, rng.randint(1, 9_000)))
            ids += stream.feed(text[k : k + n])
            k, waits = k + n, max(waits, len(stream.rest))
        assert ids + stream.finish() == whole(text)
        assert waits <= 4 * stream.lookahead + 9_000  # constant memory


def test_contractions_over_a_cut():
    for text in ("it'll we've they're 's ''ll x'", "#'ll '' 's\n\n  y", "'" * 30_000 + "s", " " * 40_000 + "x", "a'" * 9_000):
        for n in (1, 2, 5, 4_096):
            stream, ids = E.StreamEncoder(NAME, PATH), []
            for k in range(0, len(text) if n > 5 or len(text) < 100 else 0, n):
                ids += stream.feed(text[k : k + n])
            assert not ids or ids + stream.finish() == whole(text)


@settings(deadline=None, max_examples=80)
@given(st.text(max_size=300), st.integers(1, 7))
def test_decoding_in_steps(text, step):
    ids, decoder = E.encode(text, NAME, PATH), E.StreamDecoder(NAME, PATH)
    assert "".join(decoder.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + decoder.finish() == text


def test_table(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{PATH}/{NAME}.json")
    t.encode_special_tokens = True
    texts = [None, "", " ", "Hello <|endoftext|> world", "가나다 " * 20_000, "x" * 70_000, "Hello <|endoftext|> world"]
    rows = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in E.encode_documents(rows).collect()}
    for i, x in enumerate(texts):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])
    assert all(r.same for r in E.round_trip(rows).collect())
    assert E.encode_documents(rows.limit(0)).count() == 0
    assert dict(E.encode_documents(rows).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k"])
def test_counts_equal_lengths(name):
    from foliant.llm.packing import TokenCounter

    counter = TokenCounter(name, PATH)
    for text in ["It's HERE_now, 12²③ ½ naïve", "가나 다라  \n\n x", "\u0085\x1c a b", "ＡＢ ﬁ 日本語。", "__a__ 'll", "é नमस्ते", ""]:
        want = len(V.json_tokenizer(name, PATH).encode(text, add_special_tokens=False).ids) if name.startswith("word") else len(V.byte_encoding(name, PATH).encode_ordinary(text))
        assert counter.count(text) == want
