"""Small tables as text, Markdown, JSON or CSV, for reports. The table is collected: it must be a summary."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame

MAX_ROWS = 10_000


def cells(df: DataFrame) -> tuple[list[str], list[list]]:
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a report has more than {MAX_ROWS} rows")
    return df.columns, [list(r) for r in rows]


def _shown(x, digits: int = 3) -> str:
    return "--" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)


def text(title: str, head: list[str], rows: list[list], digits: int = 3) -> str:
    body = [head, *[[_shown(x, digits) for x in r] for r in rows]]
    widths = [max(len(r[k]) for r in body) for k in range(len(head))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths)).rstrip() for r in body]
    return "\n".join([title, lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def markdown(title: str, head: list[str], rows: list[list], digits: int = 3) -> str:
    line = lambda xs: "| " + " | ".join(xs) + " |"
    return "\n".join([f"### {title}", "", line(head), line(["---"] * len(head)), *[line([_shown(x, digits) for x in r]) for r in rows]])


def as_json(title: str, head: list[str], rows: list[list], digits: int = 3) -> str:
    """Numbers are raw, whatever the digits."""
    return json.dumps({"title": title, "headers": head, "rows": rows}, ensure_ascii=False, default=str)


def as_csv(title: str, head: list[str], rows: list[list], digits: int = 3) -> str:
    """Numbers are raw, whatever the digits."""
    out = io.StringIO()
    csv.writer(out).writerows([head, *rows])
    return out.getvalue()


FORMATS = {"text": text, "markdown": markdown, "json": as_json, "csv": as_csv}


def render(df: DataFrame, title: str, fmt: str = "text", digits: int = 3) -> str:
    """One format by name, or ``all`` of them; ``digits`` after the point in text and Markdown."""
    head, rows = cells(df)
    if fmt == "all":
        return "\n\n".join(f(title, head, rows, digits) for f in FORMATS.values())
    return FORMATS[fmt](title, head, rows, digits)
