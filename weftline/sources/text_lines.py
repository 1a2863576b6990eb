"""The line scan and the two ways to parse it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import lines as L


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """``value`` by line. Only a line feed ends a record, one carriage return before it goes, and so does a byte order mark at the file's start.

    A missing path raises AnalysisException (PATH_NOT_FOUND). Files split into many tasks.
    """
    return spark.read.option("lineSep", "\n").text(path).select(L.trim_cr(F.col("value")).alias("value"))


def parse_lines(df: DataFrame, column: str = "value", *, strict: bool = False, blank_lines: str = "error", on_error: str = "fail") -> DataFrame:
    """``number BIGINT, text STRING`` of each line.

    A malformed line fails the job whichever of the two columns is used, or with ``on_error="quarantine"``
    the result has ``number, text, bad_line`` and malformed rows carry the line in ``bad_line``. Blank lines
    are errors or, with ``blank_lines="skip"``, left out; null lines count as blank.
    """
    line = F.col(column)
    if blank_lines == "skip":
        df = df.filter(F.coalesce(F.length(line) > 0, F.lit(False)))
    number = L.whole_number(line) if strict else L.leading_number(line)
    ok = L.strict_ok(line) if strict else L.lenient_ok(line)
    text = L.text_of(line, strict)
    if on_error == "quarantine":
        return df.select(F.when(ok, number).alias("number"), F.when(ok, text).alias("text"), F.when(~ok, F.coalesce(line, F.lit(""))).alias("bad_line"))
    what = F.when(F.coalesce(F.length(line), F.lit(0)) == 0, F.lit("Empty line")).otherwise(F.concat(F.lit("Malformed line: "), L.truncate_text(line)))
    fail = lambda kind: F.raise_error(what).cast(kind)
    separated = (F.instr(line, ". ") > 1) if strict else L.has_separator(line)
    return df.select(F.coalesce(F.when(separated, number), fail("bigint")).alias("number"), F.when(ok, text).otherwise(fail("string")).alias("text"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """A staged sorted run, as sinks.files.write_run left it."""
    return spark.read.schema("number BIGINT, text STRING").parquet(path)
