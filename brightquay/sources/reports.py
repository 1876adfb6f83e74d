"""Markdown tables of small result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def markdown(df: DataFrame, digits: int = 4, most: int = 500) -> str:
    """A table of a report's rows; a report has at most ``most`` rows, more is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows")
    shown = lambda v: "n/a" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in rows]) + "\n"
