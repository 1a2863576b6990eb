"""Language identification by rank-order profiles of letter n-grams and their out-of-place distance."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import arrow_udf, free_name, held_out, ship, slices

#: N-grams of 1 to ORDER letters; letters are numbered in CODE_BITS bits, so that an n-gram and its length fit in 32.
ORDER, CODE_BITS = 3, 10
#: Ranks of a profile, of a language or a text.
RANKS = 400
UNKNOWN = "und"
#: Characters of a text turned into n-grams at a time; counts of pieces are added up.
PIECE = 1 << 20


def _codes() -> np.ndarray:
    """For each code point 0 if it isn't a letter, else the number of its lower-case form (1 to 1023; beyond Latin, Greek and Cyrillic numbers are shared)."""
    table = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ord(ch.lower()[0])
            table[c] = low if 0 < low < 1000 else 1 + low % 1021
    return table


_TABLE: np.ndarray | None = None


def codes() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        _TABLE = _codes()
    return _TABLE


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text and their counts. Runs of other characters, and the text's ends, are one boundary (0)."""
    c = codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([[0], c, [0]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
    parts = [_counted(c, at, min(at + PIECE, len(c))) for at in range(0, len(c), PIECE)]
    if len(parts) == 1:
        return parts[0]
    grams, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return grams, np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def _counted(c: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that begin in [start, end), letters alone for n = 1."""
    of = c[start:end]
    grams = [of[of != 0] | np.uint32(1 << 30)]
    if not len(grams[0]) and len(c) < 3:
        return np.array([], np.uint32), np.array([], np.int64)
    for n in range(2, ORDER + 1):
        last = min(end, len(c) - n + 1)
        of = (of[: max(0, last - start)] << np.uint32(CODE_BITS)) | c[start + n - 1 : max(start, last) + n - 1]
        grams.append(of | np.uint32(n << 30))
    every = np.sort(np.concatenate(grams))
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.array([], np.int64)
    return every[first], np.diff(np.append(first, len(every)))


def top(grams: np.ndarray, counts: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent n-grams, the most frequent first; equal counts in the order of the n-grams' numbers."""
    key = (counts.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - grams.astype(np.uint64))
    if len(key) > ranks:
        key = np.partition(key, len(key) - ranks)[len(key) - ranks :]
    key = np.sort(key)[::-1]
    return (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.uint32)


@dataclass
class Profiles:
    """The ranked n-grams of each language. Its size is RANKS numbers a language."""

    languages: list[str]
    ranked: list[np.ndarray]

    def __post_init__(self) -> None:
        self.grams = np.unique(np.concatenate(self.ranked)) if self.ranked else np.array([], np.uint32)
        self.places = np.full((len(self.grams) + 1, len(self.languages)), RANKS, np.int32)
        for i, own in enumerate(self.ranked):
            self.places[np.searchsorted(self.grams, own), i] = np.arange(len(own))

    def distances(self, ranked: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language; an n-gram that a profile hasn't is RANKS places off."""
        at = np.searchsorted(self.grams, ranked)
        hit = at < len(self.grams)
        hit[hit] = self.grams[at[hit]] == ranked[hit]
        places = self.places[np.where(hit, at, len(self.grams))]
        off = np.abs(places - np.arange(len(ranked), dtype=np.int32)[:, None])
        return np.where(places == RANKS, RANKS, off).sum(0, dtype=np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language (of ties the first by name) and the share of the greatest distance that it stays below."""
        if not text or not self.languages:
            return UNKNOWN, 0.0
        ranked = top(*ngrams(text))
        if not len(ranked):
            return UNKNOWN, 0.0
        d = self.distances(ranked)
        best = int(d.argmin())
        return self.languages[best], float(1 - d[best] / (RANKS * len(ranked)))


def _profile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang) to summed (lang, gram, n) of each batch."""
    for batch in batches:
        got: dict[str, list] = {}
        texts, langs = batch.column(0), batch.column(1).to_pylist()
        at = 0
        for part in slices(texts):
            for text in part.to_pylist():
                if text:
                    got.setdefault(langs[at], []).append(ngrams(text))
                at += 1
        for lang, found in got.items():
            grams, where = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([c for _, c in found])).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_col: str = "doc_id", folds: int = 4, fold: int = 2, max_rows: int = 20_000) -> Profiles:
    """Profiles from rows with a language, outside the held-out fold.

    ``max_rows`` bounds the sample (as its expected size; rows are taken by a hash of id and text), so training costs the same at any scale.
    Languages without a letter in their rows get no profile; no usable rows give no profiles, and every text is ``und``.
    """
    ship(docs.sparkSession)
    usable = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null and text is not null").filter(~held_out(F.col("id"), folds, fold))
    total = docs.select(F.col(id_col).alias("id"), F.col(lang).alias("lang")).filter("lang is not null").count()
    share = int(min(1.0, max_rows / max(1, total)) * (1 << 30))
    sample = usable.filter(F.pmod(F.xxhash64("id", "text", F.lit(29)), F.lit(1 << 30)) < share)
    counted = sample.select("text", "lang").mapInArrow(_profile_rows, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= RANKS).collect()  # RANKS rows a language
    languages = sorted({r["lang"] for r in rows})
    ranked = [np.array([r["gram"] for r in sorted((r for r in rows if r["lang"] == name), key=lambda r: r["rank"])], np.uint32) for name in languages]
    return Profiles(languages, ranked)


def predicted(text: Column, profiles: Profiles) -> Column:
    """``struct<lang, score>`` of a text."""

    @arrow_udf("struct<lang: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [profiles.predict(x) for part in slices(batch) for x in part.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang", "score"])

    return predict(text)


def identify(docs: DataFrame, profiles: Profiles, *, text: str = "text", id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per input row: id, ``held_out``, ``lang_pred``, ``score`` (0 to 1). Null texts and texts without a letter are ``und`` with score 0.

    Whole texts are counted, in pieces of bounded size. Repeated rows and null ids stay; other columns play no part.
    """
    p = docs.select(F.col(id_col).alias("id"), predicted(F.col(text), profiles).alias("p"))
    return p.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), F.col("p.lang").alias("lang_pred"), "p.score")


def keep_identified(docs: DataFrame, profiles: Profiles, *, text: str = "text", least: float = 0.05, languages: list[str] | None = None) -> DataFrame:
    """The rows, whole, whose text is in one of the languages (all learned ones unless given) with a score of ``least``."""
    name = free_name(docs, "lang_of")
    wanted = profiles.languages if languages is None else languages
    return docs.withColumn(name, predicted(F.col(text), profiles)).filter(F.col(name)["lang"].isin(*wanted) & (F.col(name)["score"] >= least)).drop(name)
