"""Problem 5: texts cut off by a field limit or mid-transfer.

For every source (table and backend) a log-normal length distribution is fitted by maximum likelihood, where values that pile up at a candidate
limit, in characters or bytes, count as right-censored there. A value at a limit gets the posterior that it was censored, rather than being
that long by chance; other values get the source's remainder. This is combined, as log odds, with evidence from the ending: a full stop, a broken
character or tag, an unfinished table row, a last word that hardly ever ends a sentence or isn't a word, and whether the next page of the
document goes on with the sentence. Only endings and beginnings leave the texts; counts are aggregated before they reach the driver.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import edges, scans
from foliant.llm.lexicon import WORD, Lexicon, form, lexicon
from foliant.llm.lookalikes import canonical
from foliant.session import materialize, spread

#: Kinds of endings that a cut usually leaves; the others are judged by the posterior at a limit alone.
OPEN = ("text", "list", "broken", "table_cut", "stretch")
#: A limit needs this many open endings, and this share of the source's.
LEAST, SHARE = 5, 0.02
#: Log odds of a cut away from every limit: what an open ending gets, and a closed one.
AWAY, AWAY_CLOSED = -1.2, -7.0
#: Marks that end sentences.
STOPS = ".!?。！？…"
#: Lengths on either side of a limit that show how many values are that long by nature.
BESIDE = 10
_END = re.compile(r"(?:[.!?。！？…][\"'”’»)\]*_`]*|[.!?。]\s*(?:\[\d+\]|\(\d+\)|\*\*|<\|[A-Z_0-9]+\|>)+)\s*$")
_BROKEN = re.compile(r"�\s*$|&(?:[a-z]{1,5}|#\d{0,5})$|<\|?[A-Za-z_0-9/]*\|?$|(?<!\])\[\d{0,3}$|\s\*{1,2}$|\\$")
_HALF = re.compile(r"([^\W_]+)(?:[-¬]|\xad)\s*$")
_LIST = re.compile(r"\s*(?:[-*+•]\s|\d+[.)]\s|>\s)")
#: Last lines that are no running line for sure; a line that this lets through costs only another look.
_NEVER_DROPPED = re.compile(r"^\s*\|.*\w|^\s*[-*+•]\s+\S{8}|[!?。]\s*$")
_CLOSING = re.compile(r"(?:\s*<!--.*?-->|\s*<\|[A-Z_0-9]+\|>)+\s*$")


def _may_drop(line: Column) -> Column:
    """Lines that ``edges`` may find to be running lines or page numbers; any other is never dropped."""
    return (F.length(line) <= edges.LONGEST) & edges.may_run(line)


def ends_of(rows: DataFrame, src: str, key: str, text: str, order: str | None, label: str | None) -> DataFrame:
    """What is needed of each row that isn't blank; the text itself stays behind.

    ``tops``: the first lines up to the first that is no running line for sure, each with its first word; ``endings``: how the text ends,
    and how it ends if its last lines are running lines. Both are read from the whole text. ``endings`` is null after a full stop, where no line is dropped.
    """

    @F.pandas_udf("array<struct<line:string,kind:string,word:string,last:string>>")
    def endings_of(texts: pd.Series) -> pd.Series:
        return texts.map(read_endings, na_action="ignore")

    t = F.col(text)
    ends = lambda marks: functools.reduce(Column.__or__, [F.endswith(t, F.lit(m)) for m in marks])
    # only the last piece may hold line ends; none begins with white space. Long pieces are never decoded as a whole, but for those in doubt
    fence = lambda x: (F.startswith(x, F.lit("```")) | F.startswith(x, F.lit("~~~"))) & x.rlike(r"^(?:```|~~~)(?:markdown|md)?\s*$")
    lines = F.filter(F.split(F.ltrim(t, F.lit(edges.SPACES)), r"\n\s*", edges.LINES + 3), lambda x: (F.ltrim(x, F.lit(edges.SPACES + "\ufeff")) != "") & ~fence(x))
    heads = F.transform(lines, lambda x: F.struct(F.substring_index(x, "\n", 1).alias("line"), F.regexp_extract(F.substring_index(x, "\n", 2), r"^\s*\S+\s?", 0).alias("begins")))
    tops = F.transform(heads, lambda x: F.struct(F.when(_may_drop(x["line"]), F.trim(x["line"])).alias("line"), x["begins"].alias("begins")))
    stays = F.array_position(F.transform("tops", lambda x: x["line"].isNull()), F.lit(True))
    closed = F.when(ends(".!?。！？"), True).when(~ends(edges.SPACES), False).otherwise(t.rlike(r"[.!?。！？]\s*\z"))
    open_ = F.when(~closed, t)
    lone = F.substring_index(F.rtrim(t), " ", -2).rlike(r"[.!?。！？]\S*\s+[^\s.!?。！？]+[.!?。！？]\s*\z")
    base = rows.where(edges.visible(t)).select(
        F.lit(src).alias("src"), F.col(key).alias("row_id"), "pdf_path", "page_num", "backend", (F.col(order) if order else F.lit(0)).alias("place"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"),
        F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), (F.length(t) - F.length(F.translate(t, STOPS, ""))).alias("stops"), tops.alias("tops"), lone.alias("lone"), endings_of(open_).alias("endings"),
    )
    return base.withColumn("tops", F.slice("tops", 1, F.when(stays > 0, stays.cast("int")).otherwise(edges.LINES + 1)))


def _ending_lines(text: str, wanted: int) -> list[str]:
    """The last ``wanted`` lines that hold something, with what stands before the first of them in its paragraph, however long that is."""
    lines, at, seen = [], len(text), 0
    while True:
        start = text.rfind("\n", 0, at) + 1
        line = text[start:at]
        if line.strip():
            seen += 1
        elif seen >= wanted:
            break
        lines.append(line)
        if not start:
            break
        at = start - 1
    return lines[::-1]


def read_endings(text: str) -> list[tuple[str | None, str, str, str]]:
    """Endings of a text: (last line if it may be a running line, kind, last word, last line as read), the next one without that line.

    The first whose line turns out to stay is the text's own; a text has at most ``edges.LINES`` running lines at its end.
    """
    lines, out = _ending_lines(text, edges.LINES + 1), []
    fence = max(text.rfind("\n```"), text.rfind("\n ```")) + 1 if "\n```" in text or "\n ```" in text else 0 if text.startswith("```") else -1
    fences = len(re.findall(r"(?m)^\s*```", text)) if fence >= 0 else 0
    # inside an open fence with a language everything is code
    code = bool(fences % 2 and re.match(r"\s*```(?!markdown|md)\w+", text[fence : fence + 40]))
    while len(out) <= edges.LINES:
        while lines and not canonical(lines[-1].replace("\u200b", "")).strip():
            lines.pop()
        if not lines:
            out.append((None, "none", "", ""))
            break
        line = lines[-1]
        may = len(out) < edges.LINES and len(line) <= edges.LONGEST and not _NEVER_DROPPED.search(line)
        out.append((line.strip(" ") if may else None, *read_ending(lines, fences, code)))
        if not may:
            break
        lines.pop()
    return out


def read_ending(lines: list[str], fences: int, code: bool) -> tuple[str, str, str]:
    """Kind of the ending, the last word as the lexicon writes it, and the last line. ``code``: the text ends in an open fence of a language."""
    raw = lines[-1].replace("\u200b", "")
    if raw.rstrip().endswith("\ufffd"):
        return "broken", "", raw.rstrip()
    last = canonical(raw)
    if re.match(r"\s*(```|~~~)", last):
        return ("closed" if fences % 2 == 0 else "code"), "", last
    if code:
        return "code", "", last
    last = _CLOSING.sub("", last) or last
    if last.lstrip().startswith("#"):
        return "heading", "", last
    if last.lstrip().startswith("|"):
        last = re.sub(r"(?<=\|)\s*(?:\(\d{1,3}\)|\[\d{1,3}\])\s*$", "", last)
        return ("table" if last.rstrip().endswith("|") else "table_cut"), "", last
    if _BROKEN.search(last):
        return "broken", "", last
    words = WORD.findall(last)
    word = form(words[-1].lower()) if words else ""
    if len(words) == 1 and len(lines) > 1 and (half := _HALF.search(canonical(lines[-2]))) and last.lstrip().startswith(words[0]):
        word = form((half[1] + words[0]).lower())  # its first half ends the line before
    if _END.search(last):
        return "end", word, last
    if not re.search(r"[^\W_]", last) or len(last.split()[-1]) > 40:
        return "stretch", "", last  # a rule, or letters without any blank: nothing tells where it should end
    # a wrapped line belongs to the list item, or the paragraph, that it goes on
    for x in reversed(lines):
        x = canonical(x)
        if _LIST.match(x):
            return "list", word, last
        if not x.strip() or _END.search(x) or x.lstrip().startswith(("#", "|")):
            break
    return "text", word, last


def goes_on(words: Lexicon, word: str, last: str, following: str | None) -> float:
    """Log odds that the next page's first line goes on with the sentence."""
    following = canonical(following or "").strip()
    if not following or re.match(r"(?:#|\||```|[-*+•]\s|\d+[.)]\s|>\s)", following):
        return -2.0
    first = WORD.match(following)
    odds = 0.0
    if following[0].islower():
        odds += 4.0
    elif first is not None:
        f = form(first[0].lower())
        n = words.times.get(f, 0)
        if n:
            s = words.starts.get(f, 0) / n
            # a capital within a sentence is a name's (or a noun's), which seldom starts one
            odds += (1.0 if s < 0.01 else 0.0 if s < 0.03 else -2.5) if first[0][0].isupper() else max(-3.0, min(3.0, math.log((1.02 - s) / (s + 0.02))))
        elif first[0][0].isupper():
            odds -= 0.5
    elif following[0] in ",;:)]、":
        odds += 3.0
    # pages end between words; a cut seldom does, and then what is left begins another word
    return odds + (1.2 if word in words.times else -2.5 if words.begins(word) else 0.0)


def ending_odds(words: Lexicon, kind: str, word: str, last: str, following: str | None, label: str | None, chars: int) -> float:
    """Log odds of a cut that the ending alone gives."""
    if kind in ("none", "closed", "code", "heading"):
        return -5.0
    if kind == "end":
        return -7.0
    if kind == "stretch":
        return -3.0
    if kind == "table":
        return -6.0
    if kind == "broken":
        return 5.0
    if kind == "table_cut":
        return 2.5
    n, e = words.times.get(word, 0), words.ends.get(word, 0)
    share = e / n if n else 0.0
    finished = 2.5 if not n else 3.0 if share < 0.003 else 1.5 if share < 0.02 else -1.0 if share < 0.06 else -2.0
    if word in ("", "0"):
        finished = 0.0
    if kind == "list":
        # an item ends without a full stop, but with a whole word that may end a sentence
        finished = 4.5 if n and (e + 0.5) / (n + 1) < 0.004 and not word.endswith("-0") or not n and word not in ("", "0") and words.begins(word) else min(finished, 1.0)
        return -2.5 + finished - 1.6 * max(0.0, goes_on(words, word, last, following))
    if chars < 45 and not re.search(r"[.!?。]\s", last) and len(last.split()) <= 6 and (label not in (None, "text") or n and share > 0 or not re.search(r"[^\W\d_]", last)):
        return -2.0
    if label in ("chart", "image", "number", "header", "footer", "paragraph_title", "code") and chars < 60:
        return -3.0
    on = goes_on(words, word, last, following)
    return 2.0 + 0.5 * finished - (1.6 * on if on > 0 else 0.5 * on)


def _log_normal(bins: dict[float, float], censored: dict[float, float]) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood, with counts at limits right-censored (EM)."""
    x, n = np.array(list(bins)), np.array(list(bins.values()), float)
    mu = float((x * n).sum() / n.sum())
    sd = max(0.2, math.sqrt(float((n * (x - mu) ** 2).sum() / n.sum())))
    for _ in range(40):
        s1, s2, total = float((x * n).sum()), float((n * x * x).sum()), float(n.sum())
        for limit, count in censored.items():
            z = (limit - mu) / sd
            tail = max(1e-9, 0.5 * math.erfc(z / math.sqrt(2)))
            hazard = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
            mean = mu + sd * hazard
            s1 += count * mean
            s2 += count * (mean * mean + sd * sd * max(0.02, 1 + z * hazard - hazard * hazard))
            total += count
        mu, sd = s1 / total, max(0.2, math.sqrt(max(0.01, s2 / total - (s1 / total) ** 2)))
    return mu, sd


def fit_limits(tallies: list, counts: list, candidates: list) -> dict[tuple, dict[tuple, float]]:
    """For each (src, backend): the posterior of censoring for a value of each kind of ending at each limit, keyed (kind, unit, limit).

    The values at a limit are a mixture of censored ones and of ones that are that long by nature. How many of the latter there are comes from the
    fitted density at the limit, over all endings, and from the lengths beside it; a kind's share of them is its share away from the limits. The
    open kinds are one class. Values that end in a sentence of a single word are censored no more often than a cut falls behind such a sentence, so
    texts that a writer filled up to the limit with something stay whole. ``counts``: how many values have each kind and each length within ``BESIDE`` of a limit.
    """
    by: dict[tuple, dict[float, float]] = {}
    kinds: dict[tuple, dict[str, float]] = {}
    marks: dict[tuple, list[int]] = {}
    for r in tallies:
        source, x = (r["src"], r["backend"]), r["bin"] / 20 + 0.025
        kind = _class(r["kind"])
        kinds.setdefault(source, {})[kind] = kinds.setdefault(source, {}).get(kind, 0) + r["n"]
        if kind != "open" or r["kind"] != "stretch":
            by.setdefault(source, {})[x] = by.setdefault(source, {}).get(x, 0) + r["n"]
        sums = marks.setdefault(source, [0, 0])
        sums[0], sums[1] = sums[0] + r["stops"], sums[1] + r["chars"]
    limits = {(c["src"], c["backend"], c["unit"], c["at"]) for c in candidates}
    at, beside = {}, {}
    for r in counts:
        k = (r["src"], r["backend"], r["unit"], r["at_limit"])
        kind = (*k, _class(r["kind"]))
        if r["away"] == 0:
            at[kind] = at.get(kind, 0) + r["n"]
        elif (*k[:3], r["at_limit"] + r["away"]) not in limits:
            beside[kind] = beside.get(kind, 0) + r["n"]
    found: dict[tuple, dict[tuple, float]] = {}
    for source, bins in by.items():
        mine = [c for c in candidates if (c["src"], c["backend"]) == source]
        for c in mine:  # a censored value isn't an observed length too
            if c["unit"] == "chars" and (x := math.floor(math.log(c["at"]) * 20) / 20 + 0.025) in bins:
                bins[x] = max(0.0, bins[x] - c["open"])
        if not any(bins.values()):
            bins = dict.fromkeys(bins, 1.0)
        mu, sd = _log_normal(bins, {math.log(c["at"]): c["open"] for c in mine if c["unit"] == "chars"})
        total = sum(bins.values())
        shares = kinds[source]
        shares["open"] = max(1.0, shares.get("open", 0) - sum(c["open"] for c in mine if c["unit"] == "chars"))
        every = sum(shares.values())
        for c in mine:
            at_chars = c["at"] if c["unit"] == "chars" else c["at"] * c["ratio"]
            z = (math.log(at_chars) - mu) / sd
            natural = total * math.exp(-z * z / 2) / (at_chars * sd * math.sqrt(2 * math.pi)) * (1 if c["unit"] == "chars" else c["ratio"])
            for kind in shares:
                k = (*source, c["unit"], c["at"], kind)
                if n := at.get(k):
                    # half a value more, so that a single one proves nothing
                    by_nature = max(natural * shares[kind] / every, beside.get(k, 0) / (2 * BESIDE)) + (0.25 if kind != "open" else 0.0)
                    censored = n - by_nature
                    if kind == "lone":
                        # a limit cuts right behind a full stop, or the blank after it, as often as those stand in the source's texts
                        behind = min(0.9, 2 * marks[source][0] / max(1, marks[source][1]))
                        alone = shares["lone"] / (shares["lone"] + shares.get("end", 0)) if shares["lone"] > n else 0.0
                        censored = min(censored, c["open"] * behind / (1 - behind) * alone)
                    found.setdefault(source, {})[(kind, c["unit"], c["at"])] = max(0.005, min(0.995, censored / n))
    return found


def _class(kind: str) -> str:
    return "open" if kind in OPEN else kind


def readings(pages: DataFrame, blocks: DataFrame) -> tuple[DataFrame, Lexicon]:
    """Every row with its ending and the first word of its body, and the lexicon."""
    words = lexicon(scans.scanned_rows(pages, blocks).select("text"))
    lines = scans.running(pages, blocks).where("is_header OR is_number").groupBy("src", "row_id").agg(F.collect_set(F.trim("line")).alias("dropped"))
    rows = ends_of(spread(pages, "page_id"), "pages", "page_id", "markdown", None, None).unionByName(ends_of(spread(blocks, "block_key"), "blocks", "block_key", "block_content", "block_order", "block_label"))
    joined = rows.join(lines, ["src", "row_id"], "left")
    stays = lambda x: x["line"].isNull() | ~F.coalesce(F.array_contains("dropped", x["line"]), F.lit(False))
    own = F.get(F.filter("endings", stays), 0)
    first = F.get(F.filter("tops", stays), 0)["begins"]
    kind = F.when(F.col("endings").isNull(), "end").otherwise(F.coalesce(own["kind"], F.lit("none")))
    read = joined.select("src", "row_id", "pdf_path", "page_num", "backend", "place", "label", "chars", "bytes", "stops", first.alias("first"), F.when((kind == "end") & F.col("lone"), "lone").otherwise(kind).alias("kind"), F.coalesce(own["word"], F.lit("")).alias("word"), F.coalesce(own["last"], F.lit("")).alias("last"))
    return materialize(read, "endings"), words


def with_following(table: DataFrame) -> DataFrame:
    """Rows whose ending is open, with the first line of the next page's body where they end their page."""
    body = table.where("first IS NOT NULL").select("src", "pdf_path", "page_num", "backend", F.struct("place", "row_id", "first").alias("key"))
    # by backend, and by whichever parse there is
    mine = body.groupBy("src", "pdf_path", (F.col("page_num") - 1).alias("page_num"), "backend").agg(F.min("key").alias("mine"))
    any_ = mine.groupBy("src", "pdf_path", "page_num").agg(F.min("mine").alias("any"))
    last = table.where("kind <> 'none'").groupBy("src", "pdf_path", "page_num", "backend").agg(F.max("place").alias("last_place"))
    followed = table.where(F.col("kind").isin(*OPEN)).drop("first").join(mine, ["src", "pdf_path", "page_num", "backend"], "left").join(any_, ["src", "pdf_path", "page_num"], "left").join(last, ["src", "pdf_path", "page_num", "backend"], "left")
    return followed.withColumn("following", F.when(F.col("place") == F.col("last_place"), F.coalesce("mine.first", "any.first"))).drop("mine", "any", "last_place")


def length_counts(rows: DataFrame) -> DataFrame:
    """For every source, kind of ending, unit (chars or bytes) and length: values and the mean of characters a byte. Small: written once."""
    lost = F.when((F.col("kind") == "broken") & F.col("last").endswith("\ufffd"), F.lit(3)).otherwise(F.lit(0))
    lengths = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("at")), F.struct(F.lit("bytes").alias("unit"), (F.col("bytes") - lost).alias("at")))
    long_ = rows.where("kind <> 'none' AND chars >= 40").select("src", "backend", "kind", (F.col("chars") / F.col("bytes")).alias("ratio"), "stops", "chars", F.inline(lengths))
    sums = [F.count("*").alias("n"), F.sum("ratio").alias("ratios"), F.sum("stops").alias("stops"), F.sum("chars").alias("chars")]
    return materialize(long_.groupBy("src", "backend", "kind", "unit", "at").agg(*sums), "lengths")


def limits_of(rows: DataFrame) -> dict[tuple, dict[tuple, float]]:
    """Posteriors of censoring for each source (see ``fit_limits``). What reaches the driver is bounded: log bins, 1/SHARE limits a source and unit, and
    2 BESIDE + 1 counts a limit and kind."""
    counted = length_counts(rows)
    tallies = counted.where("unit = 'chars'").groupBy("src", "backend", "kind", F.floor(F.log("at") * 20).alias("bin")).agg(F.sum("n").alias("n"), F.sum("stops").alias("stops"), F.sum("chars").alias("chars")).collect()
    open_ = F.col("kind").isin("text", "list", "table_cut") | ((F.col("kind") == "broken") & (F.col("unit") == "bytes"))
    by_length = counted.where(F.col("kind").isin("end", "lone", "text", "list", "broken", "table_cut")).groupBy("src", "backend", "unit", "at").agg(
        F.sum("n").alias("all"), F.coalesce(F.sum(F.when(open_, F.col("n"))), F.lit(0)).alias("open"), (F.sum("ratios") / F.sum("n")).alias("ratio")
    )
    opens: dict[tuple, int] = {}
    for r in tallies:
        if r["kind"] in ("text", "list", "broken", "table_cut"):
            opens[r["src"], r["backend"]] = opens.get((r["src"], r["backend"]), 0) + r["n"]
    if not opens:
        return {}
    enough = rows.sparkSession.createDataFrame([(*k, max(float(LEAST), SHARE * n)) for k, n in opens.items()], "src string, backend string, enough double")
    same = ((F.col("c.src") == F.col("e.src")) & F.col("c.backend").eqNullSafe(F.col("e.backend")))
    candidates = by_length.alias("c").join(F.broadcast(enough.alias("e")), same).where("open >= enough AND open >= 0.3 * all").select("c.*").collect()
    near = [(c["src"], c["backend"], c["unit"], c["at"], d) for c in candidates for d in range(-BESIDE, BESIDE + 1) if c["at"] + d > 0]
    if not near:
        return fit_limits(tallies, [], [])
    lengths = rows.sparkSession.createDataFrame(near, "src string, backend string, unit string, at_limit long, away int").withColumn("at", F.col("at_limit") + F.col("away"))
    same = (F.col("c.src") == F.col("l.src")) & F.col("c.backend").eqNullSafe(F.col("l.backend")) & (F.col("c.unit") == F.col("l.unit")) & (F.col("c.at") == F.col("l.at"))
    counts = counted.alias("c").join(F.broadcast(lengths.alias("l")), same).select("c.src", "c.backend", "c.kind", "c.unit", "l.at_limit", "l.away", "c.n").collect()
    return fit_limits(tallies, counts, candidates)


def judged(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """src, row_id, backend, kind, the posterior of censoring at a limit (0 for a length that is at none), and the log odds and verdict of a cut.

    Null, empty and blank texts aren't cut off and are left out. Repeated rows are each judged. Extra columns are ignored.
    """
    rows, words = readings(pages, blocks)
    limits = limits_of(rows)
    sent = rows.sparkSession.sparkContext.broadcast((words, limits))

    @F.pandas_udf("censored double, odds double")
    def judge(src: pd.Series, backend: pd.Series, kind: pd.Series, word: pd.Series, last: pd.Series, following: pd.Series, label: pd.Series, chars: pd.Series, bytes_: pd.Series) -> pd.DataFrame:
        lexicon_, limits_ = sent.value
        out = []
        for s, b, k, w, x, f, m, c, n in zip(src, backend, kind, word, last, following, label, chars, bytes_):
            odds = ending_odds(lexicon_, k, w, x, f if isinstance(f, str) else None, m if isinstance(m, str) else None, int(c))
            own = limits_.get((s, b), {})
            # a broken character takes up to three bytes more or less than what was stored
            near = [own["open", "chars", c]] if ("open", "chars", c) in own else []
            near += [own["open", "bytes", n - d] for d in ((0,) if not (k == "broken" and x.endswith("\ufffd")) else (-1, 0, 1, 2, 3)) if ("open", "bytes", n - d) in own]
            p = max(near, default=None)
            out.append((p or 0.0, odds + (max(-5.0, min(5.0, math.log(p / (1 - p)))) if p is not None else AWAY)))
        return pd.DataFrame(out, columns=["censored", "odds"])

    opened = with_following(rows).withColumn("j", judge("src", "backend", "kind", "word", "last", "following", "label", "chars", "bytes")).select(
        "src", "row_id", "backend", "kind", "j.censored", F.round("j.odds", 4).alias("odds"), (F.col("j.odds") > 0).alias("cut")
    )
    # a closed ending tells no more than how many values with such an ending the limit has too many
    closed = rows.where(~F.col("kind").isin(*OPEN))
    p = [F.lit(0.0)]
    for (src, backend), found in limits.items():
        mine = (F.col("src") == src) & F.col("backend").eqNullSafe(F.lit(backend))
        for (kind, unit, at), chance in found.items():
            if kind != "open":
                p.append(F.when(mine & (F.col("kind") == kind) & (F.col(unit) == at), chance).otherwise(0.0))
    closed = closed.withColumn("p", F.greatest(*p) if len(p) > 1 else p[0])
    odds = F.round(F.when(F.col("p") > 0, F.log(F.col("p") / (1 - F.col("p")))).otherwise(AWAY_CLOSED), 4)
    closed = closed.select("src", "row_id", "backend", "kind", F.col("p").alias("censored"), odds.alias("odds"), (F.col("p") > 0.5).alias("cut"))
    return opened.unionByName(closed)


def cut_rates(judged_rows: DataFrame) -> DataFrame:
    """For every table and backend (null is one): rows with text, cut rows and their share."""
    return judged_rows.groupBy("src", "backend").agg(F.count("*").alias("rows"), F.count_if("cut").alias("cut"), F.round(F.count_if("cut") / F.count("*"), 6).alias("share"))
