"""Global orders, sorted runs, merges and ranks. Text orders by unsigned UTF-8 bytes, then numbers as signed integers."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import lines as L
from weftline.functions.columns import free_name, long_array
from weftline.staging import shared_dir

KEYS = ("text", "number")


def sort_lines(df: DataFrame) -> DataFrame:
    """A sampled range exchange on both keys and a spilling sort in each range. A hot text still spreads by number."""
    return df.orderBy(*KEYS)


def sort_single(df: DataFrame) -> DataFrame:
    """One sorted partition, for inputs of one chunk at most."""
    return df.repartition(1).sortWithinPartitions(*KEYS)


def sort_shard(df: DataFrame, shards: int) -> DataFrame:
    """So many ranges, each sorted by a task of its own."""
    return df.repartitionByRange(shards, *KEYS).sortWithinPartitions(*KEYS)


def generate_runs(df: DataFrame) -> DataFrame:
    """Each partition sorted where it lies, without an exchange: a partition is a run."""
    return df.sortWithinPartitions(*KEYS)


def sorted_runs(df: DataFrame, run: str, runs: int) -> DataFrame:
    """``rn``: place of each row in its run. ``run`` is a column of numbers from 0 to ``runs`` - 1; each run is made the partition of that number and sorted there."""
    placed = generate_runs(df.repartitionById(runs, F.col(run).cast("int")))
    return placed.withColumn("rn", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1)


def merge_groups(run: F.Column, width: int) -> F.Column:
    """The group of ``width`` neighbouring runs that one merge pass joins."""
    return F.floor(run / width).cast("bigint")


def ranked(ordered: DataFrame, name: str = "rn") -> DataFrame:
    """``name``: the 1-based place of each row of a frame that is in order from partition to partition.

    A row's rank is its place in its partition plus the rows of the partitions before it, of which the driver gets one count
    each. No window runs over all rows in one task. The ordered rows are checkpointed in the shared folder, so that counts and places come
    from the same partitions, and a lost executor costs nothing.
    """
    at, part = free_name(ordered, "at"), free_name(ordered, "part")
    shared_dir(ordered.sparkSession)
    placed = ordered.withColumn(at, F.monotonically_increasing_id()).checkpoint(eager=True)
    counts = dict(placed.groupBy(F.shiftright(at, 33).cast("int").alias(part)).count().collect())
    before = long_array([0, *accumulate(counts.get(i, 0) for i in range(max(counts, default=0)))])
    return placed.withColumn(name, F.element_at(before, F.shiftright(at, 33).cast("int") + 1) + F.col(at).bitwiseAND((1 << 33) - 1) + 1).drop(at)


def with_rank(df: DataFrame, *keys: str, partitions: int | None = None, name: str = "rn") -> DataFrame:
    """``name``: the global 1-based place in the order of ``keys``, ties in any order. Ranges are sorted apart."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranked(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys), name)


def sort_prefix(df: DataFrame, n: int, by: str = "number") -> DataFrame:
    """``number, text, rn``: the first ``n`` rows in the order of ``by`` are sorted among themselves, all others keep their places."""
    placed = with_rank(df.select(*KEYS, by) if by not in KEYS else df.select(*KEYS), by, name="pos")
    head = ranked(sort_lines(placed.filter(F.col("pos") <= n).select(*KEYS)))
    return head.select("number", "text", "rn").unionByName(placed.filter(F.col("pos") > n).select("number", "text", F.col("pos").alias("rn")))


def shard_rank(df: DataFrame, shards: int) -> DataFrame:
    """``shard, rn``: uniform 16-bit shards sorted apart and joined end to end.

    Kept for its routing law: such shards are uneven, so sort_lines and sort_shard are the ones to run.
    Each shard is ranked through sampled ranges, so an uneven one is still the work of many tasks.
    """
    sharded = df.withColumn("shard", L.shard_id(L.shard_key2(F.col("text")), shards))
    return with_rank(sharded, "shard", *KEYS)


def first_seen(df: DataFrame, *by: str) -> DataFrame:
    """``seen_before``: whether an earlier row has the same text. Earlier is by the columns ``by`` (``number`` if none is given, nulls first), then by position.

    Rows stay; only the flag tells: of the rows of a text just one has it false, ties and repeated rows included. Null texts are one text. The earliest
    row of each text comes from an aggregate with partial sums, so a hot text's rows don't meet in one task other than as partial minima; the flag comes back
    by a join that adaptive execution may split. Positions are fixed by a checkpoint, so both sides see the same.
    """
    at, first, same = free_name(df, "at"), free_name(df, "first"), free_name(df, "same")
    shared_dir(df.sparkSession)
    placed = df.withColumn(at, F.monotonically_increasing_id()).checkpoint(eager=True)
    firsts = placed.groupBy(F.col("text").alias(same)).agg(F.min(F.struct(*(by or ("number",)), at))[at].alias(first))
    return placed.join(firsts, placed["text"].eqNullSafe(firsts[same])).select(*(placed[c] for c in df.columns), (F.col(at) != F.col(first)).alias("seen_before"))


def chunk_estimate(df: DataFrame) -> DataFrame:
    """``estimate``: 32 bytes a row, and 40 and two a character for each distinct text."""
    texts = df.groupBy("text").agg(F.count("*").alias("n"))
    return texts.agg((F.sum(F.col("n") * 32) + F.sum(40 + 2 * F.length(F.col("text")).cast("bigint"))).cast("bigint").alias("estimate"))


def violations(ranked: DataFrame, shards: int = 64) -> DataFrame:
    """``violations``: neighbours by ``rn`` that are out of order; 0 for a sorted frame.

    Rows are cut into blocks of neighbouring ranks; each block's first row also goes to the block before it,
    so every neighbouring pair is seen once and no task gets all rows.
    """
    block = 1 << 16
    own = ranked.select("number", "text", "rn", F.floor((F.col("rn") - 1) / block).alias("_block"))
    edge = own.filter(((F.col("rn") - 1) % block == 0) & (F.col("rn") > 1)).withColumn("_block", F.col("_block") - 1)
    w = Window.partitionBy("_block").orderBy("rn")
    text, number = F.lag("text").over(w), F.lag("number").over(w)
    bad = (F.col("_pt") > F.col("text")) | ((F.col("_pt") == F.col("text")) & (F.col("_pn") > F.col("number")))
    return own.unionByName(edge).withColumns({"_pt": text, "_pn": number}).agg(F.coalesce(F.count_if(bad), F.lit(0)).cast("bigint").alias("violations"))
