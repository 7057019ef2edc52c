import random

import pytest

from foliant.functions import similarity as S


def test_bleu_meteor_rouge():
    text = "the quick brown fox jumps over the lazy dog"
    assert S.bleu(text, text) > 90 and S.bleu("", text) == S.bleu(text, "") == 0 and S.bleu("가 나 다 라 마", "가 나 다 라 마") > 90
    assert S.meteor(text, text) > 95 and 0 < S.meteor("the quick fox", text) < 100 and S.meteor("", text) == 0
    assert S.rouge_l(text, text) == 1 and S.rouge_l("a b c", "a x c") == pytest.approx(2 / 3, abs=1e-6)


TABLE = "<table><tr><th>h1</th><th>h2</th></tr><tr><td>{}</td><td>b</td></tr></table>"


def test_teds():
    assert S.teds(TABLE.format("a"), TABLE.format("a")) == 1 and S.teds("x", "x") == -1 and S.teds("", TABLE.format("a")) == 0
    assert 0 < S.teds(TABLE.format("a"), TABLE.format("zz")) < 1 and S.teds(TABLE.format("a") * 2, TABLE.format("a")) == 0.5
    assert S.teds(TABLE.format("a"), TABLE.format("zz"), structure_only=True) == 1


def brute(a, b):
    """Distance of forests by the plain recursion."""

    def size(f):
        return sum(1 + size(n.children) for n in f)

    def d(f, g):
        if not f or not g:
            return size(f) + size(g)
        x, y = f[-1], g[-1]
        rename = 1.0 if x.tag != y.tag else (0.0 if x.tag != "td" or not (x.text or y.text) else S._levenshtein(x.text, y.text) / max(len(x.text), len(y.text)))
        return min(d(f[:-1] + x.children, g) + 1, d(f, g[:-1] + y.children) + 1, d(x.children, y.children) + d(f[:-1], g[:-1]) + rename)

    return d([a], [b])


def test_tree_distance_against_recursion():
    rng = random.Random(2)

    def tree(depth):
        n = S.Node(rng.choice(["tr", "td"]))
        n.text = rng.choice(["", "a", "ab", "b"]) if n.tag == "td" else ""
        n.children = [tree(depth - 1) for _ in range(rng.randint(0, 2))] if depth else []
        return n

    for _ in range(60):
        a, b = tree(2), tree(2)
        assert S.tree_distance(a, b) == pytest.approx(brute(a, b))


def test_bleu_by_counts_equals_bleu_by_row(spark):

    from foliant.operators import ngrams

    rng = random.Random(4)
    words = "the a cat dog sat on mat big".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 14))), " ".join(rng.choice(words) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    rows += [(900, None, "a cat"), (901, "", ""), (902, "a cat", None), (903, "the cat sat on the mat", "the cat sat on the mat"), (904, "x " * 500, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k long, p string, g string, n int")
    got = {r.k: r.bleu for r in ngrams.bleu_scores(df, "k", "p", "g").collect()}
    assert len(got) == len(rows) and all(abs(got[k] - S.bleu(p, g)) <= 0.011 for k, p, g in rows) and got[903] == 100.0
    assert ngrams.bleu_scores(df.limit(0), "k", "p", "g").count() == 0
