"""Names that clash with no column, and small constant lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as it takes to clash with no column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def long_array(values: list[int]) -> Column:
    """A constant array of longs: one literal in the plan however many there are, folded once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
