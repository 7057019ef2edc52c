"""Markdown, HTML and layout text as Column expressions; no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Normalisation rules in order: name, Java pattern, replacement (fixed values).
FENCE = r"(?msd)^```(?:markdown|md)?\s*\n(.*?)^```\s*$"
LOCATION = r"<\|[A-Z_]+\d*\|>"
BULLET = r"(?md)^(\s*)[*+•](\s)"
BOLD_HEADER = r"(?md)^(#{1,6}\s+)\*\*(.+?)\*\*\s*$"
QUOTE = r"(?md)^>\s?(.*)$"


def strip_ends(c: Column) -> Column:
    """Without white space (of any kind) at either end."""
    return F.regexp_replace(c, r"^[\s\x{B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{B}\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$", "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and figures; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """Pieces between white space, without empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def strip_fences(c: Column) -> Column:
    return F.regexp_replace(c, FENCE, "$1")


def strip_locations(c: Column) -> Column:
    return F.regexp_replace(c, LOCATION, "")


def unify_bullets(c: Column) -> Column:
    return F.regexp_replace(c, BULLET, "$1-$2")


def plain_headers(c: Column) -> Column:
    return F.regexp_replace(c, BOLD_HEADER, "$1$2")


def strip_quotes(c: Column) -> Column:
    return F.regexp_replace(c, QUOTE, "$1")


def respace_tables(c: Column) -> Column:
    """Table rows cell by cell with one blank around each cell; other lines stay."""
    row = lambda line: F.concat(F.lit("| "), F.array_join(F.transform(F.split(F.regexp_replace(strip_ends(line), r"^\||\|$", ""), r"\|"), strip_ends), " | "), F.lit(" |"))
    return F.array_join(F.transform(F.split(c, "\n"), lambda line: F.when(strip_ends(line).rlike(r"^\|(?:.*\|)?$") & (F.length(strip_ends(line)) > 1), row(line)).otherwise(line)), "\n")


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"(?md) +$", ""), r"\n{4,}", "\n\n\n")


def normalize_markdown(c: Column) -> dict[str, Column]:
    """The normalised text and, by rule, how often it applied (0 or 1 for the last two)."""
    fence = strip_fences(c)
    location = strip_locations(fence)
    bullets = unify_bullets(location)
    headers = plain_headers(bullets)
    quotes = strip_quotes(headers)
    tables = respace_tables(quotes)
    blanks = collapse_blanks(tables)
    return {
        "text": strip_ends(blanks),
        "fences": F.regexp_count(c, F.lit(FENCE)),
        "locations": F.regexp_count(fence, F.lit(LOCATION)),
        "bullets": F.regexp_count(location, F.lit(BULLET)),
        "headers": F.regexp_count(bullets, F.lit(BOLD_HEADER)),
        "quotes": F.regexp_count(headers, F.lit(QUOTE)),
        "tables": (tables != quotes).cast("int"),
        "blanks": (blanks != tables).cast("int"),
    }


def structure(c: Column) -> dict[str, Column]:
    """Headers, tables, formulas and code by their marks; words and lines by count."""
    return {
        "has_headers": c.rlike(r"(?md)^#{1,4}\s"),
        "has_tables": c.contains("|"),
        "has_formulas": c.contains("$"),
        "has_code": c.contains("```"),
        "word_count": F.size(words(c)),
        "line_count": F.size(F.split(c, "\n")),
    }


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_html(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_html(c: Column) -> Column:
    """Tags become blanks, entities characters, white space single."""
    return strip_ends(F.regexp_replace(unescape_html(F.regexp_replace(c, r"<[^>]+>", " ")), r"\s+", " "))


def html_to_markdown(c: Column) -> Column:
    """Headings, paragraphs, list items and figures of simple HTML as markdown; other tags go."""
    for n in range(1, 7):
        c = F.regexp_replace(c, rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", "\n" + "#" * n + " $1\n")
    c = F.regexp_replace(c, r"(?is)<li[^>]*>(.*?)</li>", "\n- $1")
    c = F.regexp_replace(c, r"(?is)<p[^>]*>(.*?)</p>", "\n$1\n")
    c = F.regexp_replace(c, r"(?is)<figure[^>]*>(.*?)</figure>", "\n[figure] $1\n")
    c = unescape_html(F.regexp_replace(c, r"<[^>]+>", ""))
    return strip_ends(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def ascii_only(c: Column) -> Column:
    """Every character beyond ASCII as a question mark, so that byte and character distances agree."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", "?")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length over texts with single blanks; 1 for two empty texts."""
    a, b = (strip_ends(F.regexp_replace(x, r"\s+", " ")) for x in (a, b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest))
