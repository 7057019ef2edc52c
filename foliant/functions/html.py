"""HTML tables and simple HTML as markdown, in Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import strip_ends

TABLE = r"(?s)<table[^>]*>.*?</table>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def table_cells(html: Column) -> Column:
    """Rows of cells, without tags and white space at the ends. A cell counts once, whatever columns it spans."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda row: F.regexp_extract_all(row, F.lit(r"(?s)<(?:th|td)[^>]*>(.*?)</(?:th|td)>"), F.lit(1))
    return F.transform(rows, lambda row: F.transform(cells(row), lambda c: strip_ends(F.regexp_replace(c, r"<[^>]+>", ""))))


def table_markdown(html: Column) -> Column:
    """A pipe table: the first row, a rule, the other rows; shorter rows are filled up. Without rows, the text without tags. Null stays null."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def lines(rows: Column) -> Column:
        def filled(width: Column) -> Column:
            body = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
            return let(body, lambda b: F.array_join(F.concat(F.slice(b, 1, 1), F.array(line(F.array_repeat(F.lit("---"), width))), F.slice(b, 2, F.size(b))), "\n"))

        return F.when(F.size(rows) == 0, strip_ends(F.regexp_replace(html, r"<[^>]+>", " "))).otherwise(let(F.array_max(F.transform(rows, F.size)), filled))

    return let(table_cells(html), lines)


def simple_markdown(html: Column) -> Column:
    """Tables, headings, paragraphs, list items and figures as markdown; other tags go, entities stay. Null stays null."""
    parts, tables = F.split(html, TABLE), F.regexp_extract_all(html, F.lit(TABLE), F.lit(0))
    c = let(tables, lambda found: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(table_markdown(F.get(found, i)), F.lit("")))), ""))
    for n in range(1, 7):
        c = F.regexp_replace(c, rf"(?s)<h{n}[^>]*>(.*?)</h{n}>", "#" * n + " $1")
    c = F.regexp_replace(c, r"(?s)<p[^>]*>(.*?)</p>", "$1\n")
    c = F.regexp_replace(c, r"(?s)<li[^>]*>(.*?)</li>", "- $1\n")
    c = F.regexp_replace(c, r"(?s)<figure[^>]*>.*?</figure>", "![image](/image/placeholder)\n")
    return strip_ends(F.regexp_replace(c, r"<[^>]+>", ""))
