"""First and last lines of pages and blocks, and which of them are running lines of their document.

Only short lines at the top and bottom leave the text, cut out by JVM expressions. A line is reduced to a key (letters only, with
commonly confused letters made alike, without numbers and without what follows a slash); a key that stands on two pages of one document, or
that is a heading's too, is a running line (a line without a document code must stand at the edge of three pages and of three in ten). Printed page numbers are read with their offset from the page's place in the document.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.lookalikes import canonical

LINES, LONGEST = 3, 110
#: Characters that recognition confuses, made alike for comparing lines.
ALIKE = (("0", "o"), ("1", "l"), ("|", "l"), ("i", "l"), ("5", "s"), ("@", "a"), ("c", "e"), ("f", "t"), ("9", "g"), ("6", "b"), ("2", "z"), ("rn", "m"), ("el", "d"), ("ll", "u"), ("vv", "w"), ("ln", "m"), ("rl", "n"))
_NUMBER = r"(\d{1,4}|[ivxlc]{1,7})"
#: A printed page number that stands alone; the second form is a bare number, which needs support.
ALONE = re.compile(rf"^(?:[-–—]\s*{_NUMBER}\s*[-–—]|\[{_NUMBER}\]|(?:page|pg?\.|seite|s\.|p[áa]gina|페이지|쪽|ページ)\s*{_NUMBER}(?:\s*(?:of|von|sur|de|/)\s*\d+)?|{_NUMBER}\s*(?:쪽|페이지|ページ|頁)|{_NUMBER}\s*/\s*\d{{1,4}})$", re.I)
BARE = re.compile(rf"^{_NUMBER}$", re.I)
WITH = re.compile(rf"^{_NUMBER}\s*\|\s*(?=\S)|(?<=\S)\s*\.{{4,}}\s*{_NUMBER}$|(?<=\S)(?:\s{{3,}}|\t)\s*{_NUMBER}$|(?<=\S)\s*\|\s*{_NUMBER}$", re.I)
_MARKED = re.compile(r"^\s*(?:#|[-*+•>]\s|\||\d+[.)]\s|```|~~~)")
#: Place tokens that a parser left in a line.
_LEFTOVER = re.compile(r"<\|[A-Z_]+\d*\|>")
_FIGURE = re.compile(r"\d|\b[ivxlcIVXLC]+\b")
_CODE = re.compile(r"\b[A-Z]{1,4}-\d{2,6}\b")
#: What any line must hold that ``WITH`` matches.
_MAY_BE_WITH = re.compile(r"[|\t]|\.{4}|\s{3}")
_LONE_FIGURES = re.compile(r"(?<![^\W_])\d+(?![^\W_])")
_NO_LETTER = re.compile(r"[^\w]+|_")
#: No single letter is made alike to one that is itself replaced, so those go in one pass.
_ALIKE_LETTERS, _ALIKE_PAIRS = str.maketrans({a: b for a, b in ALIKE if len(a) == 1}), [x for x in ALIKE if len(x[0]) > 1]
#: Java's white space.
SPACES = " \t\n\x0b\f\r"


def value_of(number: str) -> int | None:
    if number.isdigit():
        return int(number)
    total, last = 0, 0
    for c in reversed(number.lower()):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}.get(c)
        if v is None:
            return None
        total, last = (total - v, last) if v < last else (total + v, v)
    return total


#: A figure may itself be misread.
_FIGURE_FIX = str.maketrans("OoIlZSbB", "00112568")


def page_number(line: str) -> tuple[int | None, str]:
    """The number a line prints and how it stands: 'alone', 'bare', 'with' (in a running line) or ''."""
    s = line.strip()
    for pattern, kind in ((ALONE, "alone"), (BARE, "bare"), (WITH, "with")):
        m = pattern.search(s) if kind != "with" or _MAY_BE_WITH.search(s) else None
        if m is None and kind == "alone" and any(c.isdigit() for c in s) and len(s) < 18:
            m = pattern.search(re.sub(r"(?<![^\W\d_])[\dOoIlZSbB]+(?![^\W\d_])", lambda x: x[0].translate(_FIGURE_FIX) if any(c.isdigit() for c in x[0]) else x[0], s))
        if m:
            number = next(g for g in m.groups() if g)
            return value_of(number), kind
    return None, ""


def key_of(line: str) -> str:
    """What two prints of one running line share."""
    s = canonical(line)
    s = (_LEFTOVER.sub("", s) if "<|" in s else s).strip()
    s = WITH.sub(" ", s) if _MAY_BE_WITH.search(s) else s
    s = re.sub(r"^\s*#+\s*", "", s).split(" / ")[0].lower()
    s = _LONE_FIGURES.sub("", s).translate(_ALIKE_LETTERS)
    for a, b in _ALIKE_PAIRS:
        s = s.replace(a, b)
    return _NO_LETTER.sub("", s)


def visible(text: Column) -> Column:
    """Whether the text holds anything but Java's white space; no regular expression, so the text isn't decoded."""
    return F.ltrim(text, F.lit(SPACES)) != ""


def edge_lines(rows: DataFrame, src: str, key: str, text: str, whole: bool) -> DataFrame:
    """The first and last lines of each row: src, row_id, pdf_path, page_num, place (0.. from the top, -1.. from the bottom), line, before.

    ``whole``: the row is one block, so its line counts only if it is the only one. ``before`` is the line before it.
    """
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"^\s*+(?!```|~~~)\S"))
    base = rows.where(visible(F.col(text))).select(F.lit(src).alias("src"), F.col(key).alias("row_id"), "pdf_path", "page_num", lines.alias("ls"))
    # a filter on the lines would be pushed below them, and the text split once more for it
    n = F.size("ls")
    if whole:
        only = F.array(F.struct(F.lit(0).alias("place"), F.get("ls", F.lit(0)).alias("line"), F.lit("").alias("before")))
        return base.select("src", "row_id", "pdf_path", "page_num", F.inline(F.when((n == 1) & (F.length(F.get("ls", F.lit(0))) <= LONGEST), only)))
    at = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(2 * LINES)) - 1), lambda i: F.when(n <= 2 * LINES, i).when(i < LINES, i).otherwise(n - 2 * LINES + i))
    picked = F.transform(at, lambda i: F.struct(F.when((i < LINES) & ((i < n - i - 1) | (n > 2 * LINES)), i).otherwise(i - n).cast("int").alias("place"), F.get("ls", i).alias("line"), F.coalesce(F.get("ls", i - 1), F.lit("")).alias("before")))
    return base.select("src", "row_id", "pdf_path", "page_num", F.inline(F.when(n > 0, picked))).where(F.length("line") <= LONGEST).where(may_run(F.col("line")))


def may_run(line):
    """Lines that can be running lines, headings or page numbers; rows of tables, list items and ends of sentences can't. In the JVM."""
    number = line.rlike(r"^\P{L}*[-–—]\s*\S{1,7}\s*[-–—]\s*$") | line.rlike(r"\.{4,}\s*\S+\s*$")
    return number | ~line.rlike(r"^\s*(?:[|>]|[-*+•]\s|\d+[.)]\s)|[.!?。:;,]\s*$")


def read_lines(lines: DataFrame) -> DataFrame:
    """Each edge line with its key, whether it is a heading, whether its shape allows a running line, and the page number it prints."""

    @F.pandas_udf("lkey string, heading boolean, shaped boolean, coded boolean, alone boolean, number int, stands string")
    def look(line: pd.Series, before: pd.Series) -> pd.DataFrame:
        out = []
        for s, b in zip(line, before):
            s = _LEFTOVER.sub("", canonical(s)).strip()
            number, stands = page_number(s) if len(s) < 10 or _FIGURE.search(s) else (None, "")
            heading, body = s.startswith("#"), stands in ("alone", "bare")
            ended = bool(re.search(r"[.!?。:;,]$", s)) and not re.search(r"\.{4,}$", s)
            coded = bool(_CODE.search(s))
            # a running line begins like a title and doesn't go on with the sentence before
            flows = coded and bool(b.strip()) and not re.search(r"[.!?。|`:]\W*$", b.strip()) and not _MARKED.match(b) and not (page_number(b)[1] or _CODE.search(b))
            shaped = not body and not heading and not ended and not _MARKED.match(s) and bool(re.search(r"[^\W\d_]{2}", s)) and not re.search(r"[=(){}<>;\"`]|, ", s)
            # a title by its looks alone: a few words that end in the document's code, and no other figures
            title = WITH.sub(" ", s).strip(" —–-").split(" / ")[0] if coded else ""
            alone = coded and bool(re.fullmatch(r"[^\W\d_a-z][^\d]{2,60} [A-Z]{1,4}-\d{2,6}", title)) and len(title.split()) <= 8
            out.append((key_of(s) if shaped or heading else None, heading, shaped, coded, alone and not flows, number, stands))
        return pd.DataFrame(out, columns=["lkey", "heading", "shaped", "coded", "alone", "number", "stands"])

    return lines.withColumn("look", look("line", "before")).select("src", "row_id", "pdf_path", "page_num", "place", "line", "look.*")


def running_lines(read: DataFrame) -> DataFrame:
    """For every edge line: ``is_header`` and ``is_number``. ``read`` is used several times, so give a materialized table."""
    good = read.where(F.length("lkey") >= 5)
    outer = F.col("place").between(-2, 1)
    seen = good.groupBy("pdf_path", "lkey").agg(
        F.count_distinct(F.when(F.col("shaped"), F.col("page_num"))).alias("on_pages"),
        F.count_distinct(F.when(F.col("shaped") & outer, F.col("page_num"))).alias("on_outer"),
        F.max(F.col("heading").cast("int")).alias("titled"),
    )
    pages = read.groupBy("pdf_path").agg(F.count_distinct("page_num").alias("pages"))
    seen = seen.where("on_pages > 0").join(pages, "pdf_path")
    offsets = read.where("number is not null").withColumn("offset", F.col("number") - F.col("page_num")).groupBy("pdf_path", "offset").agg(F.count_distinct("page_num").alias("agree"))
    joined = read.withColumn("offset", F.col("number") - F.col("page_num")).join(seen, ["pdf_path", "lkey"], "left").join(offsets, ["pdf_path", "offset"], "left")
    often = F.coalesce("on_pages", F.lit(0))
    usual = (F.coalesce("on_outer", F.lit(0)) >= 3) & (F.col("on_outer") >= 0.3 * F.col("pages")) & outer
    header = F.col("shaped") & (F.length("lkey") >= 5) & F.coalesce((F.col("coded") & ((often >= 2) | (F.col("titled") == 1))) | usual | (F.col("alone") & F.col("place").between(-3, 2)), F.lit(False))
    number = ((F.col("stands") == "alone") | ((F.col("stands") == "bare") & ((F.coalesce("agree", F.lit(0)) >= 2) | (F.col("offset") == 0))) | ((F.col("stands") == "with") & header))
    return joined.select("src", "row_id", "pdf_path", "page_num", "place", "line", "lkey", F.coalesce(header, F.lit(False)).alias("is_header"), F.coalesce(number, F.lit(False)).alias("is_number"))
