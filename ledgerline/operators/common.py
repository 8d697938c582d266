"""Small shared helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def scalars(one_row: DataFrame) -> dict:
    """Values of a one-row aggregate (a handful of numbers) for use as literals:
    folding a scalar into an expression avoids joining rows against a one-row table."""
    row = one_row.first()
    return row.asDict() if row is not None else {c: None for c in one_row.columns}
