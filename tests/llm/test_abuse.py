import random

import numpy as np
import pytest

from foliant.llm import abuse as A

CLEAN = ["The registrar must renew the copy within {} days.", "보증인은 수령일부터 {}일 이내에 이유서를 제출하여야 한다.", "Nach Abschnitt {} muss die Behörde antworten.", "図書館は{}件の記録を公開した。", "Kill the parent process with signal {} first.", "The rules under number {} forbid insults such as idiot."]
BAD = ["You are a pathetic idiot, number {}.", "외국인들은 전부 벌레니까 {}번 쫓아내야 한다.", "Send me your nudes tonight, {} times.", "I will break your jaw, moron {}.", "Halt die Fresse, du Vollidiot {}.", "黙れ、この馬鹿野郎{}。"]


@pytest.fixture(scope="module")
def chain():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(CLEAN).format(i) for _ in range(4)) + (" " + rng.choice(BAD).format(i) if i % 5 == 0 else "") for i in range(200)]
    return A.train_chain(texts, [None] * len(texts))


def test_undisguise():
    assert "fuck" in A.undisguise("f-u-c-k") and "idiot" in A.undisguise("1d107") and "bitch" in A.undisguise("bitchhhh") and "기생충" in A.undisguise("기-생-충") and "maskedword" in A.undisguise("s***s")
    assert A.undisguise("RX-4928 and 12 May") == "rx-4928 and 12 may"


def test_held_out(chain):
    scorer = A.Scorer(chain)
    good, bad = scorer.score([c.format(777) for c in CLEAN]), scorer.score([b.format(777) for b in BAD])
    assert good[:, -1].max() < 0.5 < bad[:, -1].min()
    assert scorer.score([None, "", " ", "…"]).sum() == 0
    hidden = scorer.score(["You are an 1d107 and everyone knows it.", "y-o-u stupid b-i-t-c-h"])
    assert hidden[:, -1].min() > 0.5
    # a passage scores the same alone and inside a long text
    alone = scorer.score([BAD[0].format(3)])[0]
    inside = scorer.score(["\n".join(CLEAN[0].format(i) for i in range(500)) + "\n" + BAD[0].format(3)])[0]
    assert np.allclose(alone, inside)


def test_agreed_labels_decide():
    rng = random.Random(2)
    plain = lambda i: " ".join(rng.choice(CLEAN[:5]).format(i) for _ in range(3))
    unseen = ["Nobody would miss a zurgling grobnik like this one {}.", "Every zurgling grobnik in office {} should rot.", "That zurgling grobnik wrote page {}."]
    texts = [plain(i) for i in range(120)] + [plain(i) + " " + unseen[i % 3].format(i) for i in range(12)] + [plain(i) + f" Get lost, tourist, says sign {i}." for i in range(12)]
    labels = [0.0] * 120 + [1.0] * 12 + [0.0] * 12
    scorer = A.Scorer(A.train_chain(texts, labels))
    found = scorer.score(["What a zurgling grobnik.", "Get lost, tourist, says sign 99.", CLEAN[0].format(5), CLEAN[2].format(6)])[:, -1]
    assert found[0] > 0.5 and found[1:].max() < 0.5


def test_lone_labels_weigh_by_the_errors_of_reviewers():
    labels, raters = [1.0] * 13 + [0.0] * 155 + [0.5] * 13 + [1.0] * 51 + [0.0] * 451, [2] * 181 + [1] * 502
    hits = [True] * 13 + [False] * 168 + [True] * 39 + [False] * 12 + [True] * 2 + [False] * 449
    got = A.label_odds(labels, raters, hits)
    assert min(got[:13]) > 0.95 and max(got[13:168]) < 0.05 and got[170] is None and got[181] > 0.9 and got[230] < 0.5 and got[-1] < 0.05
    assert A.label_odds([1.0], [2], [False])[0] > A.label_odds([1.0], [1], [False])[0]


def test_tables(spark, chain):
    rows = [(1, CLEAN[0], "s"), (2, BAD[0], "s"), (3, None, None), (4, "", None), (2, BAD[0], "s")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(1, "r", 0), (2, "r", 1), (2, "q", None)], "doc_id long, rater string, abuse int")
    got = A.scores(docs, labels, chain).collect()
    assert {(r.doc_id, r.score >= A.CUTOFF) for r in got} == {(1, False), (2, True), (3, False), (4, False)} and len(got) == 5
    assert A.scores(docs, labels).where(f"score >= {A.CUTOFF}").count() == 2  # fitted on almost nothing but the examples
    rates = {r.source: r for r in A.source_rates(A.scores(docs, labels, chain, ("source",))).collect()}
    assert rates["s"].flagged == 2 and rates["s"].documents == 3 and rates[None].documents == 2
    assert A.scores(docs.limit(0), labels.limit(0)).count() == 0


def test_sample_is_bounded(spark):
    long_ = " ".join(f"Plain sentence number {i} of the register." for i in range(3000)) + " You pathetic idiot." + " x" * 5000
    for label, most in ((1.0, A.BAD_EACH), (0.0, A.CLEAN_EACH), (None, A.OTHER_EACH)):
        got = A.training_passages(long_, label)
        assert len(got) == most and all(len(p[0]) <= A.LONGEST for p in got)
        # what has a stem comes first; a plain passage stands for those left out
        assert got[0][0] == "you pathetic idiot" and got[0][1][0] == 1.0 and got[0][3] == 1.0 and got[-1][3] > 1
    docs = spark.createDataFrame([(i, long_ if i == 0 else CLEAN[i % 6].format(i)) for i in range(40)] + [(40, None), (41, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, None)], "doc_id long, abuse int")
    rows = A.sample(docs, labels)
    assert len(rows) <= A.PASSAGES and {(r[1], r[2]) for r in rows if r[0] == "0"} == {(1.0, 2)} and {(r[1], r[2]) for r in rows if r[0] == "2"} <= {(None, 0)}
