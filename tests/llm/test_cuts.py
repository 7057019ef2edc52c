import random

from foliant.llm import cuts

WORDS = "the registrar must deliver a certified copy of this contract within seven days and every notice counts".split()


def sentences(rng, n, longest=14):
    return " ".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, longest))).capitalize() + "." for _ in range(n))


def tables(spark, texts, backend="b"):
    pages = spark.createDataFrame([(i, f"{i}.pdf", 1, backend, t, 0) for i, t in enumerate(texts)], "page_id long, pdf_path string, page_num int, backend string, markdown string, odds int")
    return pages, spark.createDataFrame([], "block_key long, pdf_path string, page_num int, block_order int, block_label string, block_content string, backend string")


def test_kinds():
    of = lambda t: cuts.read_endings(t)[0][1:3]
    assert of("a whole sentence.") == ("end", "sentence") and of("a broken sen") == ("text", "sen") and of("# A title") == ("heading", "")
    assert of("| a | b |") == ("table", "") and of("| a | b") == ("table_cut", "") and of("- an item") == ("list", "item") and of("lost �") == ("broken", "")
    assert of("```python\n" + "x = 1\n" * 900 + "y = ") == ("code", "") and of("```\ncode\n```") == ("closed", "")
    # an item is an item however long ago it began, and a word may be split over a line end
    assert of("- an item\n" + "that goes on\n" * 200 + "and on") == ("list", "on") and of("a certi-\nfied") == ("text", "certified")
    # what stands before a line that may be a running line
    assert [e[1] for e in cuts.read_endings("a broken sen\n\nSome Title AB-12\n- 7 -")] == ["list", "text", "text", "none"]
    assert cuts.read_endings("   ")[0][1] == "none"


def test_every_value_has_a_posterior(spark):
    rng = random.Random(1)
    whole = [sentences(rng, rng.randint(2, 9)) for _ in range(300)]
    cut = [sentences(rng, 30)[:200] for _ in range(60)]
    cut = [t if t[-1] not in ". " else t[:-1] + "x" for t in cut]
    filled = [sentences(rng, 30)[: 120 + i].rsplit(".", 1)[0] + ". " for i in range(12)]
    filled = [t + "Q" * (199 - len(t)) + "." for t in filled]  # filled up to the limit by the writer
    got = {r.row_id: r for r in cuts.judged(*tables(spark, whole + cut + filled)).collect()}
    assert all(r.censored is not None and r.odds is not None for r in got.values())
    assert all(got[i].cut for i in range(300, 360)) and not any(got[i].cut for i in range(300)) and not any(got[i].cut for i in range(360, 372))
    assert all(got[i].kind == "lone" and 0 < got[i].censored < 0.5 for i in range(360, 372))


def test_cut_behind_a_full_stop(spark):
    """Where every few characters a sentence ends, a limit often cuts behind a full stop, and those rows are found too."""
    rng = random.Random(2)
    short = lambda n: " ".join(rng.choice(("Ja.", "No.", "So be it.", "I do.", "We go.")) for _ in range(n))
    whole, cut = [short(rng.randint(20, 60)) for _ in range(300)], [short(200)[:150] for _ in range(80)]
    got = {r.row_id: r for r in cuts.judged(*tables(spark, whole + cut)).collect()}
    stopped = [i for i in range(300, 380) if cut[i - 300].rstrip().endswith(".")]
    assert len(stopped) > 10 and all(got[i].cut for i in stopped) and sum(got[i].cut for i in range(300)) < 9


def test_tables(spark):
    pages, blocks = tables(spark, [None, "", "  ", "A whole sentence.", "A whole sentence."], None)
    got = cuts.judged(pages, blocks)
    assert [(r.row_id, r.cut) for r in got.orderBy("row_id").collect()] == [(3, False), (4, False)]
    assert [(r.src, r.backend, r.rows, r.cut) for r in cuts.cut_rates(got).collect()] == [("pages", None, 2, 0)]
    assert cuts.judged(pages.limit(0), blocks).count() == 0


def test_long_last_line_costs_little():
    import time

    cuts.read_endings("а ́")
    began = time.process_time()
    assert cuts.read_endings("a" * 40_000 + " pаy")[0][2] == "pay"
    assert time.process_time() - began < 1


def test_texts_are_split_once(spark):
    # what may be a long piece is neither split again for each look at its first line nor searched as a whole for its ending
    texts = ["\n \n# A title\n\n```md\nfirst\nsecond\n\nthird line\nfourth\nfifth\nsixth\nseventh and more", "closed. \n", "open \n", "﻿\n", "```\n", "　a。\t", "One. Word.", None, " \x0b"]
    pages, _ = tables(spark, texts)
    df = cuts.ends_of(pages, "pages", "page_id", "markdown", None, None)
    got = {r.row_id: r for r in df.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 6] and [(t.line, t.begins) for t in got[0].tops] == [("# A title", "# "), ("first", "first"), ("second", "second"), ("third line", "third ")]
    assert {i for i in got if got[i].endings is None} == {1, 5, 6} and got[6].lone and not got[1].lone
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
