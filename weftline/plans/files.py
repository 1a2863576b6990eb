"""File to file: sort a line file, generate one."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.functions import lines as L
from weftline.operators import dictionary, merge, order
from weftline.options import GeneratorOptions, SortOptions, format_size
from weftline.plans.strategy import choose_strategy
from weftline.sessions import derived
from weftline.sinks import files
from weftline.sources import generator
from weftline.sources.text_lines import parse_lines, scan_text
from weftline.staging import hadoop_path, owned

#: Free disk that a job wants on a single machine, as multiples of the input's size, by plan shape.
DISK_FACTOR = {"stream": 1.2, "mmf": 1.2, "shard": 2.4}


def input_size(spark: SparkSession, path: str) -> int:
    """Bytes of the input; FileNotFoundError if there is none."""
    at, fs = hadoop_path(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    return fs.getContentSummary(at).getLength()


def check_disk(spark: SparkSession, size: int, strategy: str, options: SortOptions) -> None:
    """OSError if the folder for temporary data has too little room. Only on a local master: a cluster's folders aren't the driver's to see."""
    if not spark.sparkContext.master.startswith("local"):
        return
    folder = options.temp_dir or spark.conf.get("spark.local.dir", None) or tempfile.gettempdir()
    need, free = int(size * DISK_FACTOR[strategy]), shutil.disk_usage(folder.split(",")[0]).free
    if free < need:
        raise OSError(f"{folder} has {format_size(free)} free, the sort wants {format_size(need)}")


def chunked(spark: SparkSession, chunk_bytes: int) -> SparkSession:
    """The session, or one of its own for the job whose scans are split into chunks of ``chunk_bytes`` at most."""
    name = "spark.sql.files.maxPartitionBytes"
    have = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    return spark if chunk_bytes >= have else derived(spark, {name: str(chunk_bytes)})


class JobGroup:
    """Runs the jobs inside under a group of their own, which SparkContext.cancelJobGroup ends; a group that the caller has set stays."""

    def __init__(self, spark: SparkSession, name: str | None):
        self.context, own = spark.sparkContext, spark.sparkContext.getLocalProperty("spark.jobGroup.id")
        self.name = name or own or f"weftline-{uuid.uuid4().hex}"
        self.set = self.name != own

    def __enter__(self) -> JobGroup:
        if self.set:
            self.context.setJobGroup(self.name, "weftline", interruptOnCancel=True)
        return self

    def __exit__(self, *_) -> None:
        if self.set:
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                self.context.setLocalProperty(key, None)


def ordered(df: DataFrame, strategy: str, partitions: int) -> DataFrame:
    """The sorted frame in one of the three plan shapes. A single partition is only taken for what one task holds well."""
    if strategy == "mmf":
        return order.sort_single(df)
    return order.sort_shard(df, partitions) if strategy == "shard" else order.sort_lines(df)


#: Text bytes up to which one task sorts faster than an exchange of ranges pays off, and from which a dictionary's extra pass does.
SINGLE_TASK_BYTES, DICTIONARY_BYTES = 4 << 20, 96 << 20


def sort_file(
    spark: SparkSession, source: str, target: str, options: SortOptions | None = None, *, single: bool = True, progress: Callable[[str], None] | None = None, job_group: str | None = None
) -> int:
    """Sorts the lines of ``source`` into ``target`` and returns the bytes written (0 for part files).

    ``single=False`` leaves ordered ``part-*`` files in the folder ``target``: the form for large results, and what an input of more than
    ``options.single_bytes`` gets in any case. Under ``auto`` an input of SINGLE_TASK_BYTES at most stays in one task; above it the range sort runs, with
    ranges of about 64 MiB unless ``partitions`` says otherwise, or from DICTIONARY_BYTES on the dictionary sort if the texts repeat. Scans are split into chunks of
    ``chunk_bytes`` at most. All jobs are in the group ``job_group`` (told to ``progress`` if it isn't given): SparkContext.cancelJobGroup ends them.
    """
    options, say = options or SortOptions(), progress or (lambda _: None)
    size = input_size(spark, source)
    strategy = choose_strategy(options.strategy, size, options.chunk_bytes, options.threads)
    if options.strategy == "auto" and strategy == "mmf" and size > SINGLE_TASK_BYTES:
        strategy = "shard"
    check_disk(spark, size, strategy, options)
    partitions = options.partitions or max(options.threads, -(-size // (64 << 20)))
    if single and size > options.single_bytes:
        single = False
        say(f"{format_size(size)} are more than one file takes: part files")
    spark = chunked(spark, options.chunk_bytes)
    with JobGroup(spark, job_group) as group, owned(spark):
        say(f"{format_size(size)}, strategy {strategy}, {partitions} ranges, job group {group.name}")
        rows = parse_lines(scan_text(spark, source), strict=options.strict, blank_lines=options.blank_lines, on_error=options.on_error)
        if options.on_error == "quarantine":
            bad = Observation()
            rows.filter("bad_line is not null").select("bad_line").observe(bad, F.count(F.lit(1)).alias("lines")).write.mode("overwrite").text(f"{target}.rejected")
            say(f"{bad.get['lines']} malformed lines in {target}.rejected")
            rows = rows.filter("bad_line is null").drop("bad_line")
        result = None
        if options.strategy == "auto" and size >= DICTIONARY_BYTES and dictionary.probe(rows):
            say("texts repeat: counting them")
            result = dictionary.sort_by_dictionary(rows, partitions)
        if result is None:
            result = ordered(rows, strategy, partitions)
        return write_ordered(result, target, single, options.single_bytes, say)


def write_ordered(result: DataFrame, target: str, single: bool, most: int, say: Callable[[str], None]) -> int:
    """Writes an ordered frame as one file or part files, tells how many records it has, and returns the bytes of the one file."""
    seen = Observation()
    # counted behind the sort: what is before a range exchange also runs to sample it
    counted = result.observe(seen, F.count(F.lit(1)).alias("records"))
    written = files.write_single(counted, target, most) if single else files.write_parts(counted, target) or 0
    say(f"{seen.get['records']} records, " + (f"wrote {format_size(written)}" if single else f"parts in {target}"))
    return written


def make_runs(spark: SparkSession, source: str, runs: str, options: SortOptions | None = None) -> int:
    """The first phase alone: each chunk of the input becomes a sorted run in the folder ``runs``. Returns how many."""
    options = options or SortOptions()
    spark = chunked(spark, options.chunk_bytes)
    merge.write_runs(parse_lines(scan_text(spark, source), strict=options.strict, blank_lines=options.blank_lines), runs)
    return len(merge.run_numbers(spark, runs))


def merge_file(spark: SparkSession, runs: str, target: str, options: SortOptions | None = None, *, single: bool = True, progress: Callable[[str], None] | None = None, job_group: str | None = None) -> int:
    """The second phase alone: merges the sorted runs in the folder ``runs``, ``merge_width`` at a time, into ``target``."""
    options = options or SortOptions()
    with JobGroup(spark, job_group), owned(spark):
        return write_ordered(merge.merge_runs(spark, runs, options.merge_width), target, single, options.single_bytes, progress or (lambda _: None))


def rebuild_run(spark: SparkSession, source: str, run: str) -> None:
    """A run from a sorted text file; lines without a separator are left out."""
    lines = scan_text(spark, source).filter(L.has_separator(F.col("value")))
    files.write_run(parse_lines(lines), run)


def generate_file(spark: SparkSession, target: str, size: int, options: GeneratorOptions | None = None, *, single: bool = True) -> int:
    """Writes lines of ``size`` bytes at least (by less than one line more); the same bytes for the same seed."""
    options = options or GeneratorOptions()
    rows = generator.generate_rows(spark, generator.rows_for(spark, size, options), options)
    return files.write_single(rows, target) if single else files.write_parts(rows, target) or 0
