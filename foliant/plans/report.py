"""Markdown reports from small result tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame

#: A report shows at most so many rows of a table; more is an error rather than a cut.
MOST = 2_000


def dash(value: object, form: str = ".4f") -> str:
    """A number in a form, a dash for null."""
    return "–" if value is None else format(value, form) if isinstance(value, float) else str(value)


def seconds(ms: float | None) -> str:
    return "–" if ms is None else f"{round(ms / 1000)}s"


def markdown_table(df: DataFrame, form: str = ".4f") -> str:
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a report table has more than {MOST} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(dash(v, form) for v in r) + " |" for r in rows])


def render(title: str, sections: dict[str, DataFrame]) -> str:
    if not sections:
        raise ValueError("a report needs at least one table")
    return "\n\n".join([f"# {title}"] + [f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items()]) + "\n"


def write_report(path: str, title: str, sections: dict[str, DataFrame]) -> Path:
    """Write through a temporary file, so that a report is either whole or absent."""
    to = Path(path)
    part = to.with_name(to.name + ".part")
    part.write_text(render(title, sections), encoding="utf-8")
    os.replace(part, to)
    return to
