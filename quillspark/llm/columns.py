"""Names for columns that an operator adds to tables it doesn't know."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` names that no column of a table has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    found: list[str] = []
    k = 0
    while len(found) < n:
        if (name := f"own_{k}") not in taken:
            found.append(name)
        k += 1
    return found
