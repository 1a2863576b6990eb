"""Sharding by a two-pass external shuffle.

The first pass sums sizes, which fixes how many memory-sized buckets each shard has, and where each bucket's slots begin. The second scatters the
records by seeded hashes to the buckets, shuffles each bucket by Fisher-Yates and places it in its shard.
The law is ``key``: the id and the number of shards decide. Each id has a hash for every shard and goes to the shard of the greatest,
so one more shard takes rows only into itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import arrow_udf, cut, free_name, ship

#: Bytes of records that a bucket holds on average: what one task shuffles in memory.
BUCKET_BYTES = 16 << 20
#: Bytes that each record takes besides its text.
OVERHEAD = 16
#: Buckets that a task of the second pass shuffles, one after the other, on average.
TASK_BUCKETS = 4
LAW = "key"


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint")


def shard_of(key: Column, shards: int, seed: str = "weft") -> Column:
    """The shard whose hash of the key is greatest (of equals the higher one). A null key is a key like any other."""
    k = F.coalesce(key.cast("string"), F.lit("null"))
    ranked = F.array(*(F.concat(F.md5(F.concat(F.lit(f"{seed}:{s}:"), k)), F.lpad(F.lit(str(s)), 8, "0")) for s in range(shards)))
    return F.substr(F.array_max(ranked), F.lit(33)).cast("int")


def grown_shard_of(key: Column, shard: Column, shards: int, seed: str = "weft") -> Column:
    """The shard with one more shard: either the same or the new one."""
    k = F.coalesce(key.cast("string"), F.lit("null"))
    new, own = F.md5(F.concat(F.lit(f"{seed}:{shards}:"), k)), F.md5(F.concat(F.lit(f"{seed}:"), shard.cast("string"), F.lit(":"), k))
    return F.when(new >= own, F.lit(shards)).otherwise(shard)


def nth_of(value: Column) -> Column:
    """How many rows before it in its partition have the same value (a long).

    Whatever order a partition's rows come in, the same values get the same numbers, so a task that runs again deals its rows alike.
    """

    @arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen: Counter[int] = Counter()
        for batch in batches:
            values = batch.to_numpy(zero_copy_only=False)
            order = np.argsort(values, kind="stable")
            v = values[order]
            first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else order
            sizes = np.diff(np.append(first, len(v)))
            keys = v[first].tolist()
            out = np.empty(len(v), np.int64)
            out[order] = np.arange(len(v)) - np.repeat(first, sizes) + np.repeat(np.array([seen[k] for k in keys], np.int64), sizes)
            for k, n in zip(keys, sizes.tolist(), strict=True):
                seen[k] += n
            yield pa.array(out)

    return count(value)


def fisher_yates(n: int, seed: int, shard: int, bucket: int) -> list[int]:
    """A permutation of n places: the last is swapped with a random one of those up to it, then the one before, and so on. Draws are hashes of the seed and the place."""
    out = list(range(n))
    stream = f"{seed}:{shard}:{bucket}:"
    for i in range(n - 1, 0, -1):
        j = xxhash.xxh64_intdigest(f"{stream}{i}") % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def shuffle_into_shards(df: DataFrame, shards: int = 40, *, text: str = "text", id_col: str = "doc_id", seed: int = 11, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of each row, whole, and ``shard``, ``slot`` (gapless from 0 in each shard), ``grown_shard``, ``size`` and ``bucket``, names free of clashes.

    Buckets are sized by what the first pass measured, so a bucket's rows fit in memory at any scale. An id's rows share a shard by the
    law, but not a bucket: buckets are drawn by a hash of the whole row (map columns are left out of it), and of rows alike in every column the first of each
    partition by that hash, all others by their number and partition as well, so that a huge group of them spreads. The order in a bucket before its shuffle is that of the
    rows' hashes, so the result of a table without such repeats doesn't depend on the run or on how it is split. Null ids are one id, null texts take OVERHEAD bytes.
    """
    ship(df.sparkSession)
    names = {x: free_name(df, x) for x in ("shard", "slot", "grown_shard", "size", "bucket", "mix", "base", "nth")}
    own = df.columns
    mix = F.xxhash64(F.lit(seed), *(F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t))
    rows = df.withColumns({names["shard"]: shard_of(F.col(id_col), shards), names["size"]: size_of(F.col(text)), names["mix"]: mix})
    total, most = rows.groupBy(names["shard"]).agg(F.sum(names["size"]).alias("s")).agg(F.sum("s"), F.max("s")).first()
    buckets = max(1, -(-(most or 0) // bucket_bytes))
    nth, mixed = F.col(names["nth"]), F.col(names["mix"])
    drawn = F.when(nth == 0, mixed).otherwise(F.xxhash64(mixed, nth, F.spark_partition_id()))
    rows = rows.withColumn(names["nth"], nth_of(mixed)).withColumn(names["bucket"], F.pmod(drawn, F.lit(buckets)).cast("int")).drop(names["nth"])
    counts = rows.groupBy(names["shard"], names["bucket"]).count()
    w = Window.partitionBy(names["shard"]).orderBy(names["bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    bases = cut(counts.select(names["shard"], names["bucket"], F.coalesce(F.sum("count").over(w), F.lit(0)).alias(names["base"])))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards * buckets // TASK_BUCKETS)
    placed = rows.join(bases, [names["shard"], names["bucket"]]).repartition(tasks, names["shard"], names["bucket"])
    schema = placed.select(*own, names["shard"], names["bucket"], names["size"], names["base"]).schema
    at = {n: i for i, n in enumerate(placed.columns)}
    shard_at, bucket_at, mix_at, base_at = (at[names[x]] for x in ("shard", "bucket", "mix", "base"))
    keep = [at[x] for x in (*own, names["shard"], names["bucket"], names["size"], names["base"])]

    def shuffled(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ordered = table.take(pc.sort_indices(pa.table({"m": table.column(mix_at)}), [("m", "ascending")]))
        shard, bucket = ordered.column(shard_at)[0].as_py(), ordered.column(bucket_at)[0].as_py()
        order = fisher_yates(len(ordered), seed, shard, bucket)
        out = ordered.take(pa.array(order))
        base = out.column(base_at)[0].as_py()
        slots = pa.array(range(base, base + len(out)), pa.int64())
        return pa.Table.from_arrays([*(out.column(i) for i in keep), slots], names=[*(out.column_names[i] for i in keep), names["slot"]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", `{names['slot']}` bigint"
    out = placed.groupBy(names["shard"], names["bucket"]).applyInArrow(shuffled, kinds)
    return out.withColumn(names["grown_shard"], grown_shard_of(F.col(id_col), F.col(names["shard"]), shards)).drop(names["base"])


def write_shards(df: DataFrame, path: str, shards: int = 40, **options) -> None:
    """The shards as folders ``shard=N`` of Parquet files, rows in slot order within each bucket's part."""
    out = shuffle_into_shards(df, shards, **options)
    name = free_name(df, "shard")
    out.write.mode("overwrite").partitionBy(name).parquet(path)

