"""Markdown reports of small aggregates, written as text files.

The driver formats what it collects, so a section takes at most ``ROWS`` rows and says so if there are more: a report
of more is an export, not a report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

ROWS = 1_000


def _cell(value) -> str:
    if value is None:
        return ""
    text = f"{value:.4f}" if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\n", " ")


def section(heading: str, rows: DataFrame, note: str = "") -> list[str]:
    """Lines of a heading, a note and a table: floats have four places, nulls are empty, bars are escaped."""
    held = rows.limit(ROWS + 1).collect()
    if len(held) > ROWS:
        raise ValueError(f"{heading}: more than {ROWS} rows")
    out = [f"## {heading}", ""] + ([note, ""] if note else [])
    out += ["| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |"]
    return [*out, *("| " + " | ".join(_cell(v) for v in r) + " |" for r in held), ""]


def write_report(title: str, sections: list[list[str]], path: str, like: DataFrame) -> DataFrame:
    """Write the report as one text file under ``path`` and read it back: (number, line)."""
    lines = [f"# {title}", "", *(x for s in sections for x in s)]
    spark = like.sparkSession
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    whole = spark.read.text(path, wholetext=True)
    numbered = whole.selectExpr("posexplode(split(value, '\\n')) AS (number, line)")
    return numbered.where(numbered["number"] < len(lines))
