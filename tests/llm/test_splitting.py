import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from foliant.llm import splitting as S


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="ab。. \n#-|가", max_size=900), st.integers(8, 120), st.integers(0, 40))
def test_pieces_hold_size_and_overlap(text, size, overlap):
    assume(overlap < size)
    pieces = S.split(text, size, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= size for a, b, _ in pieces)
    for (_, end, _), (start, _, strength) in zip(pieces, pieces[1:]):
        assert start == max(0, end - overlap)
        if strength == S.SLICE:  # a word, with its full stop, is cut only if it can't stand in a piece
            assert S.longest_stretch(text) + 1 > size - overlap


def test_the_overlap_is_as_configured():
    pieces = S.split("word " * 30, 20, 15)
    assert len(pieces) > 5 and all(start == max(0, end - 15) for (_, end, _), (start, _, _) in zip(pieces, pieces[1:])) and all(b - a <= 20 for a, b, _ in pieces)
    with pytest.raises(ValueError):
        S.split("word " * 30, 20, 20)


def test_boundaries():
    text = "# One\nFirst sentence here. Second one goes on\nover a line end.\n\n## Two\nThird sentence.\n\n- item a\n- item b"
    cuts = [text[b : b + 6] for _, b, _ in S.split(text, 70, 0)[:-1]]
    assert all(c.startswith(("## Two", "- item", "Second")) for c in cuts), cuts
    assert [s for _, _, s in S.split("word " * 30, 20, 5)[1:]] == [S.WORD] * (len(S.split("word " * 30, 20, 5)) - 1)


def test_table(spark):
    pages = spark.createDataFrame([(1, "x" * 30, 1, 0), (2, "ab cd. " * 9, 1, 0), (3, None, 1, 0), (4, "", 1, 0), (5, "short", 1, 0), (6, "y" * 99, 9, 0), (7, "z" * 99, None, 0)], "page_id long, markdown string, config_id int, chunk int")
    sizes = spark.createDataFrame([(1, 20, 4, "\n"), (2, 0, 0, "\n"), (9, 20, 20, "\n")], "config_id int, chunk_size int, chunk_overlap int, separator string")
    rows = S.split_texts(pages, sizes).collect()
    assert {r.page_id for r in rows} == {1, 2, 5} and all(r.chars <= 20 and len(r.chunk) == r.chars for r in rows)
    assert {r.page_id: r.over for r in rows} == {1: True, 2: True, 5: False}
    for page, text in ((1, "x" * 30), (2, "ab cd. " * 9)):
        mine = sorted((r for r in rows if r.page_id == page), key=lambda r: r.piece)
        assert mine[0].chunk + "".join(r.chunk[4:] for r in mine[1:]) == text
    assert S.split_texts(pages.limit(0), sizes).count() == 0
