"""Text and run sinks. Paths are Hadoop paths; the single-file sink joins parts in their order on the file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import lines as L
from weftline.staging import hadoop_path, owned, staged_path

#: Bytes that the driver joins to one file; larger results stay part files.
SINGLE_BYTES = 16 << 30


def write_parts(df: DataFrame, path: str) -> None:
    """``part-*`` text files; an ordered frame's files are in order by name. What is there goes."""
    df.select(L.format_line(F.col("number"), F.col("text")).alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def concat_parts(spark: SparkSession, parts: str, target: str, most: int = SINGLE_BYTES) -> int:
    """Joins the parts in name order to one file beside the target, then renames it into place. Returns bytes.

    The stream copy runs in the driver's JVM, so parts of more than ``most`` bytes are refused before any is copied (ValueError).
    """
    jvm = spark._jvm
    (source, fs_in), (aim, fs_out) = hadoop_path(spark, parts), hadoop_path(spark, target)
    found = sorted((s for s in fs_in.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
    if (total := sum(s.getLen() for s in found)) > most:
        raise ValueError(f"{total} bytes are too many for one file joined by the driver (limit {most}); leave them as part files")
    half = jvm.org.apache.hadoop.fs.Path(f"{target}.inprogress")
    out = fs_out.create(half, True)
    try:
        for status in found:
            if not status.getLen():
                continue
            stream = fs_in.open(status.getPath())
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()
    fs_out.delete(aim, True)  # a file, or part files of an earlier run
    if not fs_out.rename(half, aim):
        raise OSError(f"could not rename to {target}")
    return total


def write_single(df: DataFrame, target: str, most: int = SINGLE_BYTES) -> int:
    """One text file of an ordered frame; an empty frame gives an empty file. Returns bytes."""
    spark = df.sparkSession
    with owned(spark):
        write_parts(df, parts := staged_path(spark, "parts"))
        return concat_parts(spark, parts, target, most)


def write_run(df: DataFrame, path: str, count: int | None = None) -> None:
    """A typed, columnar sorted run; with ``count`` only the frame's first rows."""
    (df if count is None else df.limit(count)).select("number", "text").write.mode("overwrite").parquet(path)
