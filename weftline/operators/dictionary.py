"""The order of inputs whose texts repeat: texts become ranks in a bounded dictionary, and a record becomes one long.

A sort of longs is a radix sort, and shuffled rows carry no text. The dictionary pass also counts, so ranges are cut from exact
counts and no sampling pass runs. Inputs with many different texts, or numbers too wide to pack, take the general sort.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Different texts, and bytes of them, that a dictionary may have: it is broadcast.
MOST_TEXTS, MOST_BYTES = 1 << 16, 4 << 20
#: Rows looked at first, and the share of different texts among them above which no dictionary is tried.
PROBE_ROWS, PROBE_SHARE = 5_000, 0.25


@dataclass(frozen=True)
class Packing:
    """``key = rank * span + (number - least)``, in the order of (text, number)."""

    span: int
    least: int

    def key(self, rank: Column, number: Column) -> Column:
        return rank * F.lit(self.span) + (number - F.lit(self.least))


def range_of(number, before, rows, low, width, total: int, ranges: int):
    """The range of a record, for columns or numbers: where it stands among all if each text's rows are spread evenly over its numbers.

    ``before``: rows of the texts before its own, ``rows``: those of its own, which has numbers from ``low`` on, less than ``width`` apart. It never falls from one
    record to the next, so ranges are in order, however many there are.
    """
    place = before + rows * ((number - low) / width)
    return place * (ranges / max(1, total))


def probe(df: DataFrame) -> bool:
    """Whether the first rows have few different texts among them."""
    first = [r["text"] for r in df.select("text").limit(PROBE_ROWS).collect()]
    return bool(first) and len(set(first)) <= max(1, PROBE_SHARE * len(first))


def sort_by_dictionary(df: DataFrame, ranges: int) -> DataFrame | None:
    """``number, text`` in order in ``ranges`` partitions at most, or None if the input doesn't fit a dictionary. Nulls and texts with a line feed don't fit."""
    ranges = max(1, ranges)
    texts = df.groupBy("text").agg(F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.count("number").alias("numbers"))
    found = texts.limit(MOST_TEXTS + 1).collect()
    if not found or len(found) > MOST_TEXTS or sum(len(r["text"] or "") for r in found) > MOST_BYTES or any(r["text"] is None or "\n" in r["text"] or r["numbers"] != r["n"] for r in found):
        return None
    found.sort(key=lambda r: r["text"].encode())
    least = min(r["low"] for r in found)
    span = max(r["high"] for r in found) - least + 1
    if span * len(found) >= 1 << 62 or span >= 1 << 52:
        return None
    packing = Packing(span, least)
    before = [0, *accumulate(r["n"] for r in found)]
    rows = [(r["text"], i, float(before[i]), float(r["n"]), r["low"], float(r["high"] - r["low"] + 1)) for i, r in enumerate(found)]
    ranks = df.sparkSession.createDataFrame(rows, "text string, rank bigint, rows_before double, own_rows double, low bigint, width double")
    # an outer join, though every text has its rank: an inner one would test the parsed columns for nulls a second time
    where = range_of(F.col("number"), F.col("rows_before"), F.col("own_rows"), F.col("low"), F.col("width"), before[-1], ranges)
    packed = df.select("number", "text").join(F.broadcast(ranks), "text", "left").select(packing.key(F.col("rank"), F.col("number")).alias("key"), F.least(where.cast("int"), F.lit(ranges - 1)).alias("range"))
    ordered = packed.repartitionById(ranges, "range").sortWithinPartitions("key")
    # the way back is a folded array literal: the optimizer drops sorts below joins
    names = F.split(F.lit("\n".join(r["text"] for r in found)), "\n", -1)
    return ordered.select((F.pmod("key", F.lit(span)) + F.lit(least)).alias("number"), F.element_at(names, F.expr(f"cast(key div {span}L as int)") + 1).alias("text"))
