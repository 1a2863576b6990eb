"""What the operators share: bounded Arrow batches, names that clash with no column, staged tables."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.columns import free_name  # noqa: F401 - the operators take it from here
from weftline.staging import shared_dir, staged_path

#: Bytes of text that a Python worker holds decoded at a time (one longer text is a batch of its own).
BATCH_BYTES = 4 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package's modules to the workers of the session, once an application: they need not have it installed or stand in its folder."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent.parent
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    if not root.is_dir():
        return  # imported from an archive that was shipped already
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="weftline-")), "weftline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(archive)


def settle() -> None:
    """Gives what this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of batches, in a worker that holds before and after it only what is in use: workers stay from stage to stage, and an executor counts all that they hold."""

    @functools.wraps(f)
    def run(batches):
        settle()
        try:
            yield from f(batches)
        finally:
            settle()

    return run


def arrow_udf(returns: str):
    """functions.arrow_udf, with the package shipped to the workers of the active session, which hold no freed memory when it is done."""
    if spark := SparkSession.getActiveSession():
        ship(spark)
    return lambda f: F.arrow_udf(returns)(lean(f))


def slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Neighbouring rows of up to ``most`` bytes of text together; at least one row each."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(texts)
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def lowered(text: str) -> str:
    """The text in lower case, character for character, so that places in both are the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def held_out(doc_id: Column, folds: int, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves that remainder. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def stage_table(df: DataFrame, what: str) -> DataFrame:
    """The frame written to the shared folder as Parquet and read again: lineage ends there, and a lost executor costs nothing."""
    df.write.parquet(path := staged_path(df.sparkSession, what))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

