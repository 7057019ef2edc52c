import random

import pytest

from foliant.llm import cuts, edges, scans
from foliant.llm.lexicon import Lexicon, lexicon

WORDS = "the registrar must deliver a certified copy of this contract within seven days and every notice is well-known".split()


@pytest.fixture(scope="module")
def decoder():
    times = {w: 400 for w in WORDS} | {"은": 0, "시의회는": 300, "비용은": 300}
    return scans.Decoder(Lexicon(times, {}, {}, 20_000, 3))


def test_words(decoder):
    assert decoder.correction("certlfied") == "certified" and decoder.correction("c0py") == "copy" and decoder.correction("Thc") == "The" and decoder.correction("시의회논") == "시의회는"
    assert decoder.correction("copy") is None and decoder.correction("AB-1234") is None and decoder.correction("zebra") is None and decoder.correction("vii") is None
    assert decoder.correction("2O22") == "2022" and decoder.correction("37,6O1") == "37,601" and decoder.correction("2022") is None


def test_kinds(decoder):
    assert decoder.kinds("the certi-\nfied copy.") == (True, False)
    assert decoder.kinds("a well-\nknown notice.") == (False, False)
    assert decoder.kinds("the regis¬\ntrar must.") == (True, False)
    assert decoder.kinds("every n0tice.") == (False, True)
    assert decoder.kinds("```python\nx = l0ad(n0tice)\n```\nthe copy.") == (False, False)
    assert decoder.kinds("") == (False, False)


def test_noise_comes_from_the_lattice(decoder):
    assert decoder.kinds("the cert lfied copy.") == (False, True) and decoder.repair("the cert lfied copy.", set()) == "the certified copy."
    assert decoder.kinds("the cert ified copy.") == (False, False)  # a blank too much, but no character is wrong
    assert decoder.kinds("| every regis-\ntrar must deliver.") == (False, False)  # a row's end is a paragraph's end
    long_ = scans.Decoder(Lexicon({w: 40_000 for w in WORDS}, {}, {}, 2_000_000, 3))
    assert long_.kinds("thcnotice of.") == (False, True) and long_.repair("thcnotice", set()) == "the notice"
    assert decoder.kinds("審査委員会は9週間以内に理由を説明しなければならない。") == (False, False)


def test_letter_sums():
    assert all(scans.letter_sum(seen) == scans.letter_sum(meant) for seen, meant in scans.CONFUSIONS)
    assert scans.letter_sum("notice") != scans.letter_sum("notices")


def test_open_endings(decoder):
    assert decoder.kinds("every n0tice") == (False, True) and decoder.kinds("certlfied") == (False, True) and decoder.kinds("in 2O22") == (False, True)
    # a cut-off word that others begin with stands, whatever else it resembles
    cut = scans.Decoder(Lexicon({"lit": 5000, "lifeboat": 40}, {}, {}, 20_000, 3))
    assert cut.kinds("lit lif") == (False, False) and cut.kinds("lif lit.") == (False, True)


def test_repair(decoder):
    text = "Title X AB-12\nthe registrar must de-\nliver a certlfied\ncopy of this contract.\n\n- every notice\n- 7 -"
    assert decoder.repair(text, {"Title X AB-12", "- 7 -"}) == "the registrar must deliver a certified copy of this contract.\n\n- every notice"
    assert decoder.repair("thisnot ice", set()) == "thisnot ice" and decoder.repair("cont ract", set()) == "contract" and decoder.repair("thecopy", set()) == "the copy"


@pytest.mark.parametrize(
    "line, number, stands",
    [("- 16 -", 16, "alone"), ("Page 3 of 9", 3, "alone"), ("133/155", 133, "alone"), ("12쪽", 12, "alone"), ("[vii]", 7, "alone"), ("14", 14, "bare"), ("ix", 9, "bare"), ("A Title KX-1 ........ 31", 31, "with"), ("4 | A Title", 4, "with"), ("+33.3", None, ""), ("5,500", None, ""), ("words", None, "")],
)
def test_page_numbers(line, number, stands):
    assert edges.page_number(line) == (number, stands)


def test_noise_of_documents(spark):
    pages = [(i, "d.pdf", i, f"Some Title KX-16395 / Part {i}\n\nthe registrar must deliver a certified copy.\n{'A' if i == 1 else 'B'} notice of this contract.\n\n- {i + 4} -") for i in range(1, 4)]
    pages += [(8, "e.pdf", 1, None), (9, "e.pdf", 2, ""), (10, "e.pdf", 3, "every notice"), (11, "e.pdf", 4, "15")]
    blocks = [(1, "d.pdf", 1, "SOME TITLE KX-16395"), (2, "d.pdf", 2, "6"), (3, "d.pdf", 2, "+33.3"), (4, "d.pdf", 3, None)]
    p = spark.createDataFrame([(*r, 0) for r in pages], "page_id long, pdf_path string, page_num int, markdown string, noise int")
    b = spark.createDataFrame([(*r, 0) for r in blocks], "block_key long, pdf_path string, page_num int, block_content string, lkey int")
    got = {tuple(r) for r in scans.noise(p, b).collect()}
    assert {("pages", i, k) for i in (1, 2, 3) for k in ("header", "page_no")} | {("blocks", 1, "header"), ("blocks", 2, "page_no")} == got
    clean = {(r.src, r.row_id): r.text for r in scans.repaired(p, b).collect()}
    assert "KX-16395" not in clean["pages", 2] and "certified copy." in clean["pages", 2]
    assert scans.noise(p.limit(0), b.limit(0)).count() == 0


def test_lexicon_bound(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(WORDS) for _ in range(3000)) + " rare. Once."
    words = lexicon(spark.createDataFrame([(text,)], "text string"), share=0.01)
    assert "rare" not in words and "registrar" in words and len(words.times) <= 100


def test_endings():
    end = lambda t, d=frozenset(): next(e[1] for e in cuts.read_endings(t) if e[0] not in d or e[0] is None)
    assert [end(t) for t in ("It ends.", "It ends. [3]", "# Head", "| a | b |", "| a | b", "- item", "goes o", "x�", "fine &am", "끝났다。")] == ["end", "end", "heading", "table", "table_cut", "list", "text", "broken", "broken", "end"]
    assert end("goes on\n\n- 7 -", {"- 7 -"}) == "text" and end("```python\nx = 1") == "code" and end("  ") == "none"


def test_cuts(spark):
    full = "the registrar must deliver a certified copy of this contract within seven days. "
    rng = random.Random(3)
    rows = [(i, f"{i}.pdf", 1, "a", full * rng.randint(1, 6) + ("" if i % 3 else "every notice is well-known.")) for i in range(90)]
    rows += [(100 + i, f"c{i}.pdf", 1, "a", (("notice " * (i % 4)) + full * 9)[:200]) for i in range(40)]
    rows += [(200, "n.pdf", 1, "a", full + "every notice is"), (201, "n.pdf", 2, "a", "well-known within seven days."), (202, "x.pdf", 1, "b", None), (203, "x.pdf", 2, "b", " "), (204, "h.pdf", 1, "b", full + "\n\n# every notice")]
    pages = spark.createDataFrame(rows, "page_id long, pdf_path string, page_num int, backend string, markdown string")
    blocks = spark.createDataFrame([], "block_key long, pdf_path string, page_num int, block_order int, block_label string, block_content string, backend string")
    got = {r.row_id: r for r in cuts.judged(pages, blocks).collect()}
    at_limit = [i for i in range(100, 140) if got[i].kind != "end"]
    assert len(at_limit) > 20 and all(got[i].cut and got[i].censored > 0.8 for i in at_limit)
    assert not any(got[i].cut for i in range(90)) and not got[200].cut and not got[204].cut and 202 not in got and 203 not in got
    rates = {r.backend: r for r in cuts.cut_rates(cuts.judged(pages, blocks)).collect()}
    assert rates["a"].cut == len(at_limit) and rates["b"].cut == 0
    assert cuts.judged(pages.limit(0), blocks).count() == 0


def test_closed_endings_at_a_limit(spark):
    full = "the registrar must deliver a certified copy of this contract within seven days. "
    rng = random.Random(5)
    rows = [(i, f"{i}.pdf", 1, "a", full * rng.randint(1, 6) + "every notice." * (i % 2)) for i in range(90)]
    rows += [(100 + i, f"c{i}.pdf", 1, "a", (("notice " * (i % 4)) + full * 9)[:200]) for i in range(40)]
    rows += [(200 + i, f"e{i}.pdf", 1, "a", (full * 3)[: 200 - 7] + " of it.") for i in range(6)]  # cut right after a full stop
    rows += [(300, "n.pdf", 1, "a", (full * 3)[: 150 - 7] + " of it.")]
    pages = spark.createDataFrame(rows, "page_id long, pdf_path string, page_num int, backend string, markdown string")
    blocks = spark.createDataFrame([], "block_key long, pdf_path string, page_num int, block_order int, block_label string, block_content string, backend string")
    got = {r.row_id: r for r in cuts.judged(pages, blocks).collect()}
    assert all(got[i].kind == "end" and got[i].cut and got[i].censored > 0.8 for i in range(200, 206))
    assert got[300].censored == 0 and not got[300].cut and not any(got[i].cut for i in range(90))


def test_long_words_and_texts(decoder):
    text = "x" * 200_000 + " " + "notice " * 20_000
    assert decoder.repair(text, set()).startswith("xxx") and decoder.kinds(text) == (False, False)


def test_nulls_in_any_column(spark):
    p = spark.createDataFrame([(None, None, None, "the registrar must de-\nliver 2O22.", None), (1, "a", None, "x", None)], "page_id long, pdf_path string, page_num int, markdown string, backend string")
    b = spark.createDataFrame([(None,) * 7, (1, "a", 1, None, "text", "KX 12 Title AB-1234", None)], "block_key long, pdf_path string, page_num int, block_order int, block_label string, block_content string, backend string")
    assert {r.noise for r in scans.noise(p, b).collect()} >= {"misread"}
    assert cuts.judged(p, b).count() == 3 and scans.repaired(p, b).count() == 3


def test_paragraphs_depend_on_both_lines(decoder):
    full = "the registrar must deliver a certified copy of this contract within"
    of = lambda *lines: [len(g) for g in decoder.paragraphs(list(lines))]
    assert of(full, "seven days and every notice.", full, "seven days.") == [2, 2]
    # an indent sets off a paragraph after a full line too, but is no end within an unfinished sentence
    assert of("  " + full, full, full + ".", "  " + full, "seven days.") == [3, 2] and of(full, "  " + full, full) == [3]
    assert of("# Head", full, "seven days.", "", full) == [1, 2, 1, 1] and of("a regis-", "trar must.") == [2] and of() == [] and of("") == [1]


def test_sound_rare_words_stay(spark):
    text = " ".join(["the"] * 4000 + ["clue"] * 900 + ["due"] * 60 + ["dlue"])
    from foliant.llm.lexicon import lexicon as made

    df = spark.createDataFrame([(text,)], "text string")
    # "due" could be a misread "clue" (cl read as d), but stands too often for that
    plain, known = made(df, share=0.05), made(df, scans.rival, share=0.05)
    assert "due" not in plain and "due" in known and "dlue" not in known
    assert scans.Decoder(plain).correction("due") == "clue" and scans.Decoder(known).correction("due") is None


def test_kinds_in_batches(decoder):
    texts = ["the certi-\nfied copy.", "every n0tice.", "", "the cert lfied copy.", "a well-\nknown notice.", "every n0tice"] * 3
    assert decoder.kinds_of(texts) == [decoder.kinds(t) for t in texts] and decoder.kinds_of([]) == []


def test_edge_lines_split_a_text_once(spark):
    # fences, blank lines of any kind, a text of fences alone, and a filter on the lines that mustn't be pushed below their making
    texts = ["Title AB-12\n\n```\nx\n```\n \x0b\nlast line", "```md\n~~~", "  \n", None, "\n".join(f"line {i}" for i in range(9))]
    pages = spark.createDataFrame([(i, "a.pdf", i, t) for i, t in enumerate(texts)], "page_id long, pdf_path string, page_num int, markdown string")
    lines = edges.edge_lines(pages, "pages", "page_id", "markdown", False)
    found = sorted((r.row_id, r.place, r.line, r.before) for r in lines.collect())
    assert found == [(0, -2, "x", "Title AB-12"), (0, -1, "last line", "x"), (0, 0, "Title AB-12", "")] + [(4, k, f"line {k % 9}", f"line {k % 9 - 1}" if k else "") for k in (-3, -2, -1, 0, 1, 2)]
    blocks = edges.edge_lines(pages, "blocks", "page_id", "markdown", True)
    assert blocks.count() == 0
    for df in (lines, blocks):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
