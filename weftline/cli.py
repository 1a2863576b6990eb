"""``python -m weftline.cli sort IN OUT [...]`` and ``... generate OUT SIZE [...]``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from weftline.options import GeneratorOptions, SortOptions, default_chunk_bytes, hardware_report, parse_size
from weftline.plans.files import generate_file, sort_file


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("sort", help="sort a file of '<number>. <text>' lines by text, then number")
    s.add_argument("input")
    s.add_argument("output")
    s.add_argument("--strategy", default="auto")
    s.add_argument("--memory", type=parse_size, default=None, help="bytes of one chunk, such as 512MB")
    s.add_argument("--threads", type=int, default=os.cpu_count() or 1)
    s.add_argument("--temp", default=None, help="Spark's local folder")
    s.add_argument("--merge-width", type=int, default=64)
    s.add_argument("--buffer", type=parse_size, default=4 << 20)
    s.add_argument("--workers", type=int, default=None)
    s.add_argument("--blank-lines", choices=("error", "skip"), default="error")
    s.add_argument("--on-error", choices=("fail", "quarantine"), default="fail")
    s.add_argument("--parts", action="store_true", help="leave ordered part files")
    g = sub.add_parser("generate", help="write a file of synthetic lines")
    g.add_argument("output")
    g.add_argument("size", type=parse_size)
    g.add_argument("--phrases", type=int, default=500)
    g.add_argument("--max-number", type=int, default=100_000)
    g.add_argument("--seed", type=int, default=42)
    return p


def session(threads: int, temp: str | None, buffer: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("weftline").config("spark.ui.enabled", "false")
    if buffer:
        builder = builder.config("spark.shuffle.file.buffer", f"{max(1, buffer >> 10)}k")
    if "SPARK_MASTER" not in os.environ and not SparkSession.getActiveSession():
        builder = builder.master(f"local[{threads}]")
    if temp:
        builder = builder.config("spark.local.dir", temp)
    return builder.getOrCreate()


def main(args: list[str] | None = None) -> int:
    """0: done; 1: bad usage, missing file or malformed input; 130: interrupted."""
    try:
        a, _ = parser().parse_known_args(args)
    except SystemExit as e:
        return int(bool(e.code))
    try:
        if a.command == "generate":
            spark = session(os.cpu_count() or 1, None)
            generate_file(spark, a.output, a.size, GeneratorOptions(a.phrases, a.max_number, a.seed))
            return 0
        options = SortOptions(chunk_bytes=a.memory or default_chunk_bytes(), threads=a.threads, strategy=a.strategy, blank_lines=a.blank_lines, on_error=a.on_error, merge_width=a.merge_width, buffer_bytes=a.buffer, workers=a.workers, temp_dir=a.temp)
        spark = session(min(a.threads, a.workers or a.threads), a.temp, a.buffer)
        print("\n".join(hardware_report(options, spark.sparkContext.defaultParallelism)))
        sort_file(spark, a.input, a.output, options, single=not a.parts, progress=print)
        return 0
    except KeyboardInterrupt:
        SparkSession.getActiveSession().sparkContext.cancelAllJobs()
        return 130
    except Exception as e:  # the command's boundary: any failure is one line and an exit code
        print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
