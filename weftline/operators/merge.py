"""Sorted runs in the shared folder, and their merge level by level.

A run is a folder ``run=N`` of Parquet files, each sorted, in order by name. One level joins groups of ``width`` neighbouring runs, all in
one job: rows are dealt by ranges of (group, text, number), so a large run is the work of many tasks, and tasks sort what is in order already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import order
from weftline.staging import delete, hadoop_path, staged_path


def write_runs(df: DataFrame, path: str, run: str | None = None) -> None:
    """The frame's partitions as sorted runs, without an exchange; or the runs that the column ``run`` numbers."""
    numbered = df.withColumn("run", F.spark_partition_id()) if run is None else df.withColumnRenamed(run, "run")
    numbered.sortWithinPartitions("run", *order.KEYS).write.mode("overwrite").partitionBy("run").parquet(path)


def run_numbers(spark: SparkSession, path: str) -> list[int]:
    """The runs that are there, from the names of their folders."""
    at, fs = hadoop_path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return sorted(int(n.removeprefix("run=")) for n in names if n.startswith("run="))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def merge_level(spark: SparkSession, path: str, width: int, target: str) -> None:
    """One level: each group of ``width`` neighbouring runs becomes a run of ``target``."""
    runs = read_runs(spark, path)
    grouped = runs.withColumn("run", order.merge_groups(F.col("run"), width))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(run_numbers(spark, path)) // width)
    dealt = grouped.repartitionByRange(n, "run", *order.KEYS).sortWithinPartitions("run", *order.KEYS)
    dealt.write.mode("overwrite").partitionBy("run").parquet(target)


def merge_runs(spark: SparkSession, path: str, width: int) -> DataFrame:
    """All rows of the runs at ``path`` in order. While there are more than ``width`` runs a level is merged to new ones, which go when the next is there."""
    if width < 2:
        raise ValueError("a merge joins two runs at least")
    made = None
    while len(run_numbers(spark, path)) > width:
        merge_level(spark, path, width, target := staged_path(spark, "level"))
        if made:
            delete(spark, made)
        path = made = target
    if not run_numbers(spark, path):
        return spark.createDataFrame([], "number bigint, text string")
    return order.sort_lines(read_runs(spark, path).drop("run"))
