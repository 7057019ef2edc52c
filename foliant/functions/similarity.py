"""Text similarity without a relational form, as Arrow UDFs over pairs of columns; each pair is scored on its own."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def bleu(pred: str, gt: str) -> float:
    """4-gram BLEU in percent over white-space tokens with epsilon smoothing (0.1 for a zero count); 0 if a side is empty or no word matches."""
    p, g = (pred or "").split(), (gt or "").split()
    if not p or not g:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (p, g))
        hits = sum((a & b).values())
        if n == 1 and hits == 0:
            return 0.0
        logs += math.log((hits or 0.1) / max(1, sum(a.values())))
    brevity = 1.0 if len(p) > len(g) else math.exp(1 - len(g) / len(p))
    return round(100 * brevity * math.exp(logs / 4), 2)


def rouge_l(pred: str, gt: str) -> float:
    """F1 of the longest common subsequence of words, case ignored."""
    p, g = (pred or "").lower().split(), (gt or "").lower().split()
    if not p or not g:
        return 0.0
    row = [0] * (len(g) + 1)
    for w in p:
        before = 0
        for j, v in enumerate(g, 1):
            before, row[j] = row[j], before + 1 if w == v else max(row[j], row[j - 1])
    lcs = row[-1]
    return round(2 * lcs / (len(p) + len(g)), 6)


_SUFFIX = re.compile(r"(?:ations?|ingly|edly|ing|ies|ed|es|ly|s)$")


def stem(word: str) -> str:
    """A light English suffix stripper; other words stay."""
    short = _SUFFIX.sub("", word)
    return short if len(short) >= 3 else word


def meteor(pred: str, gt: str) -> float:
    """Exact, then stem matches in order of position, with the fragmentation penalty (alpha .9, beta 3, gamma .5), in percent. There is no synonym stage."""
    p, g = (pred or "").lower().split(), (gt or "").lower().split()
    if not p or not g:
        return 0.0
    match: dict[int, int] = {}
    used: set[int] = set()
    for f in (lambda w: w, stem):
        free: dict[str, list[int]] = {}
        for j in range(len(g) - 1, -1, -1):
            if j not in used:
                free.setdefault(f(g[j]), []).append(j)
        for i, w in enumerate(p):
            if i not in match and free.get(f(w)):
                match[i] = free[f(w)].pop()
                used.add(match[i])
    m = len(match)
    if not m:
        return 0.0
    pairs = sorted(match.items())
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(pairs, pairs[1:]))
    precision, recall = m / len(p), m / len(g)
    mean = precision * recall / (0.9 * precision + 0.1 * recall)
    return round(100 * mean * (1 - 0.5 * (chunks / m) ** 3), 2)


_TAG = re.compile(r"<(/?)(table|thead|tbody|tr|th|td)([^>]*)>|([^<]+)|<[^>]*>", re.I)


class Node:
    __slots__ = ("tag", "span", "text", "children")

    def __init__(self, tag: str, span: tuple[str, str] = ("1", "1")):
        self.tag, self.span, self.text, self.children = tag, span, "", []


def table_trees(html: str) -> list[Node]:
    """One tree of rows and cells for each table."""
    tables, stack = [], []
    for close, tag, attributes, text in _TAG.findall(html or ""):
        tag = tag.lower()
        if text:
            if stack and stack[-1].tag in ("td", "th"):
                stack[-1].text += text
        elif tag and not close:
            span = tuple((re.search(rf'{k}="?(\d+)', attributes) or ["", "1"])[1] for k in ("colspan", "rowspan"))
            node = Node(tag, span)
            if stack:
                stack[-1].children.append(node)
            elif tag == "table":
                tables.append(node)
            else:
                continue
            stack.append(node)
        elif tag and stack and any(n.tag == tag for n in stack):
            while stack.pop().tag != tag:
                pass
    return tables


def _levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def tree_distance(a: Node, b: Node, structure_only: bool = False) -> float:
    """Ordered tree edit distance (keyroots of the postorder), unit insertions and deletions; td texts differ by their normalised edit distance."""

    def flatten(root: Node) -> tuple[list[Node], list[int], list[int]]:
        nodes, left = [], []

        def walk(n: Node) -> int:
            first = None
            for c in n.children:
                f = walk(c)
                first = f if first is None else first
            nodes.append(n)
            left.append(len(nodes) - 1 if first is None else first)
            return left[-1]

        walk(root)
        roots = sorted({f: i for i, f in enumerate(left)}.values())
        return nodes, left, roots

    def rename(x: Node, y: Node) -> float:
        if x.tag != y.tag or x.span != y.span:
            return 1.0
        if x.tag == "td" and not structure_only and (x.text or y.text):
            return _levenshtein(x.text, y.text) / max(len(x.text), len(y.text))
        return 0.0

    (na, la, ra), (nb, lb, rb) = flatten(a), flatten(b)
    dist = [[0.0] * len(nb) for _ in na]
    for i in ra:
        for j in rb:
            i0, j0 = la[i], lb[j]
            f = [[0.0] * (j - j0 + 2) for _ in range(i - i0 + 2)]
            for x in range(1, i - i0 + 2):
                f[x][0] = f[x - 1][0] + 1
            for y in range(1, j - j0 + 2):
                f[0][y] = f[0][y - 1] + 1
            for x in range(1, i - i0 + 2):
                for y in range(1, j - j0 + 2):
                    u, v = i0 + x - 1, j0 + y - 1
                    if la[u] == i0 and lb[v] == j0:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[x - 1][y - 1] + rename(na[u], nb[v]))
                        dist[u][v] = f[x][y]
                    else:
                        f[x][y] = min(f[x - 1][y] + 1, f[x][y - 1] + 1, f[la[u] - i0][lb[v] - j0] + dist[u][v])
    return dist[-1][-1]


def _count(n: Node) -> int:
    return sum(1 + _count(c) for c in n.children)


def teds(pred: str, gt: str, structure_only: bool = False) -> float:
    """Mean over the true tables of the best predicted table's similarity, times the share of tables both sides have; -1 without a true table, 0 without a predicted one."""
    a, b = table_trees(pred), table_trees(gt)
    if not b:
        return -1.0
    if not a:
        return 0.0
    best = [max(1 - tree_distance(x, y, structure_only) / max(_count(x), _count(y), 1) for x in a) for y in b]
    return round(sum(best) / len(best) * min(len(a), len(b)) / max(len(a), len(b)), 4)


def _udf(f):
    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x if isinstance(x, str) else "", y if isinstance(y, str) else "") for x, y in zip(a, b)], dtype="float64")

    return scored


def bleu_column(pred: Column, gt: Column) -> Column:
    """Null texts count as empty."""
    return _udf(bleu)(pred, gt)


def rouge_l_column(pred: Column, gt: Column) -> Column:
    return _udf(rouge_l)(pred, gt)


def meteor_column(pred: Column, gt: Column) -> Column:
    return _udf(meteor)(pred, gt)


def teds_column(pred: Column, gt: Column) -> Column:
    return _udf(teds)(pred, gt)
