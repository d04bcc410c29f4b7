"""Column names that cannot clash with those of the input."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Each base, with underscores added until no column has that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        while base.lower() in taken:
            base += "_"
        taken.add(base.lower())
        out.append(base)
    return out
