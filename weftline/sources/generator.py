"""Deterministic synthetic lines: random numbers before phrases of a bounded pool."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import lines as L
from weftline.options import GeneratorOptions

#: Syllables of the generator's own vocabulary; words are pairs of them.
ONSETS = ("bar", "cel", "dor", "fen", "gal", "hul", "jas", "kel", "lom", "mir")
ENDINGS = ("ade", "bic", "den", "ful", "go", "lin", "mus", "net")


def words() -> list[str]:
    return [a + b for a in ONSETS for b in ENDINGS]


#: Hex digits of a draw: 60 bits, so that it is a positive long in any engine.
DIGITS = 15


def drawn(seed: int, what: str, i: int) -> int:
    """A number of 60 bits: the first hex digits of an MD5. The same law in Python, Spark and any SQL."""
    return int(hashlib.md5(f"{seed}:{what}:{i}".encode()).hexdigest()[:DIGITS], 16)


def draw(seed: int, what: str, i: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:{what}:"), i.cast("string")).cast("binary"))
    return F.conv(F.left(digest, F.lit(DIGITS)), 16, 10).cast("bigint")


def phrase_pool(options: GeneratorOptions) -> list[str]:
    """So many distinct phrases of one to four words, in the order found; ValueError if they can't be found in a fixed number of attempts."""
    pool, vocabulary = {}, words()
    for i in range(max(1000, 100 * options.phrases)):
        n = drawn(options.seed, "words", i) % 4 + 1
        phrase = " ".join(vocabulary[drawn(options.seed, f"word{k}", i) % len(vocabulary)] for k in range(n))
        pool.setdefault(phrase[0].upper() + phrase[1:])
        if len(pool) == options.phrases:
            return list(pool)
    raise ValueError(f"could not find {options.phrases} distinct phrases")


def generate_rows(spark: SparkSession, rows: int, options: GeneratorOptions, partitions: int | None = None) -> DataFrame:
    """``id, number, text``: the same for a seed whatever the partitions. Numbers are 1 to max_number.

    The pool is an array literal in the plan: its size is the option ``phrases``, not the data's.
    """
    pool = F.split(F.lit("\n".join(phrase_pool(options))), "\n")
    ids = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    number = F.pmod(draw(options.seed, "number", F.col("id")), F.lit(options.max_number)) + 1
    return ids.select("id", number.alias("number"), F.element_at(pool, (F.pmod(draw(options.seed, "text", F.col("id")), F.lit(options.phrases)) + 1).cast("int")).alias("text"))


def rows_for(spark: SparkSession, size: int, options: GeneratorOptions) -> int:
    """The least number of rows whose lines take ``size`` bytes; found by summing, as row lengths differ."""
    n = max(1, size // 4)
    total = lambda rows: generate_rows(spark, rows, options).agg(F.sum(L.line_bytes(F.col("number"), F.col("text")))).first()[0]
    mean = total(min(n, 100_000)) / min(n, 100_000)
    rows = max(1, int(size / mean))
    while (have := total(rows)) < size:
        rows += max(1, int((size - have) / mean) + 1)
    return rows
