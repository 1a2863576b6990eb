"""SentencePiece models on the tokenizers library: the model's protobuf is read here and its parts are rebuilt there.

Handles unigram models (scores, Viterbi) and BPE models (merges ranked by the merged piece's score), precompiled normalisation,
dummy prefix, extra white space, the metaspace marker, user-defined pieces and byte fallback. ``parity`` compares with
the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_udf, slices

#: Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"
#: Where the tokenizer files of this machine are; a parameter everywhere.
DEFAULT_MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: Text encoded at a time: a token takes far more memory than its text while it is an object.
ENCODE_BYTES = 1 << 20
#: Rows of ids decoded at a time.
ROWS = 256


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers of varints, bytes of all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + n]
        at += n


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    types: tuple[int, ...]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    trim_spaces: bool
    escape_spaces: bool


def parse(data: bytes) -> Model:
    """The parts of a serialised model that encoding and decoding depend on. ValueError for word and character models."""
    pieces, scores, types = [], [], []
    trainer: dict[int, int | bytes] = {}
    normalizer: dict[int, int | bytes] = {}
    for number, value in fields(data):
        if number == 1:
            p = dict(fields(value))
            pieces.append(p.get(1, b"").decode())
            scores.append(struct.unpack("<f", p[2])[0] if 2 in p else 0.0)
            types.append(p.get(3, NORMAL))
        elif number == 2:
            trainer = dict(fields(value))
        elif number == 3:
            normalizer = dict(fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE) or trainer.get(24, 0):
        raise ValueError("only unigram and BPE models with white space as prefix are supported")
    return Model(tuple(pieces), tuple(scores), tuple(types), kind, bool(trainer.get(35, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)), bool(normalizer.get(5, 1)))


def merges(model: Model) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, the best-scored piece first; pairs of one piece by their ids."""
    ids = {p: i for i, p in enumerate(model.pieces)}
    usable = {p for p, t in zip(model.pieces, model.types, strict=True) if t in (NORMAL, USER_DEFINED, UNUSED)}
    ranked = []
    for piece, score, kind in zip(model.pieces, model.scores, model.types, strict=True):
        if kind in (NORMAL, UNUSED):
            ranked += [(-score, ids[piece[:k]], ids[piece[k:]], piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in usable and piece[k:] in usable]
    return [(a, b) for *_, a, b in sorted(ranked)]


def build(model: Model):
    """The model as a tokenizers.Tokenizer."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    unk = model.types.index(UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), unk, model.byte_fallback)
    else:
        core = models.BPE(vocab={p: i for i, p in enumerate(model.pieces)}, merges=merges(model), unk_token=model.pieces[unk], fuse_unk=True, byte_fallback=model.byte_fallback)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Strip(left=True, right=True), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape_spaces:
        steps += ([normalizers.Prepend(MARK)] if model.dummy_prefix else []) + [normalizers.Replace(" ", MARK)]
    elif model.dummy_prefix:
        steps += [normalizers.Prepend(" ")]
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    if own := [AddedToken(p, normalized=False, special=False) for p, k in zip(model.pieces, model.types, strict=True) if k == USER_DEFINED]:
        t.add_tokens(own)
    return t


class Runs:
    """Exact order among pieces of one score that are runs of one character, as runs of the metaspace marker are in some BPE models.

    The library ranks every merge, while the format breaks ties of score by place: the leftmost merge goes first. Such merges
    come after all others, so only how a run is cut differs; runs of their tokens are cut anew by the format's rule.
    """

    def __init__(self, model: Model):
        by_score: dict[float, list[int]] = {}
        for i, (score, kind) in enumerate(zip(model.scores, model.types, strict=True)):
            if kind == NORMAL and len(model.pieces[i]) > 1:
                by_score.setdefault(score, []).append(i)
        least = min(by_score, default=0.0)
        tied = by_score.get(least, [])
        chars = {c for i in tied for c in model.pieces[i]}
        self.length: dict[int, int] = {}
        if model.kind == BPE and len(tied) > 1 and len(chars) == 1 and (char := chars.pop()) in model.pieces:
            self.char = char
            self.length = {i: len(model.pieces[i]) for i in tied} | {model.pieces.index(char): 1}
        self.piece = {n: i for i, n in self.length.items()}
        self.cuts: dict[int, list[int]] = {}

    def cut(self, n: int) -> list[int]:
        """The ids of a run of n characters: the leftmost two neighbours that make a piece are joined, again and again."""
        if n not in self.cuts:
            parts, at = [1] * n, 0
            while at + 1 < len(parts):
                if parts[at] + parts[at + 1] in self.piece:
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                    at = max(0, at - 1)
                else:
                    at += 1
            self.cuts[n] = [self.piece[x] for x in parts]
        return self.cuts[n]

    def exact(self, ids: list[int]) -> list[int]:
        out, run = [], 0
        for i in ids:
            if (n := self.length.get(i)) is not None:
                run += n
                continue
            if run:
                out += self.cut(run)
                run = 0
            out.append(i)
        return out + self.cut(run) if run else out


_BUILT: dict[str, tuple] = {}


def built(data: bytes, threads: int):
    """The tokenizer of a serialised model and its runs, made once a worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _BUILT:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        _BUILT[key] = (build(model := parse(data)), Runs(model))
    return _BUILT[key]


def read_model(path: str) -> bytes:
    """The model file's bytes, read once by the driver; they travel with the tasks (a model is under a few MB)."""
    with open(path, "rb") as f:
        return f.read()


def encode_texts(data: bytes, texts: list[str | None], threads: int = 2) -> list[list[int] | None]:
    """Ids of each text; null for null, none for an empty one."""
    t, runs = built(data, threads)
    twice = (" " if runs.length and runs.char == MARK else getattr(runs, "char", "")) * 2
    some = [i for i, x in enumerate(texts) if x]
    out: list[list[int] | None] = [None if x is None else [] for x in texts]
    for i, e in zip(some, t.encode_batch_fast([texts[i] for i in some], add_special_tokens=False), strict=True):
        # the dummy prefix may be followed by one space, so a leading one counts too
        out[i] = runs.exact(e.ids) if runs.length and (twice in texts[i] or texts[i][0] == twice[0] or MARK in texts[i]) else e.ids
    return out


def decode_ids(data: bytes, ids: list[list[int] | None], threads: int = 2) -> list[str | None]:
    t, _ = built(data, threads)
    return [None if x is None else y for x, y in zip(ids, t.decode_batch([x or [] for x in ids], skip_special_tokens=False), strict=True)]


def expected(data: bytes, text: str) -> str:
    """What decoding gives back: the text as the model normalises it, with markers as spaces."""
    m = parse(data)
    s = built(data, 1)[0].normalizer.normalize_str(text).replace(MARK, " ") if text else ""
    return s[1:] if m.dummy_prefix and s.startswith(" ") else s


ENCODED = "struct<token_ids: array<int>, round_trip: boolean>"


def encoded(text: Column, model: bytes, threads: int = 2) -> Column:
    """``struct<token_ids, round_trip>``: the ids, and whether decoding them gives the normalised text back exactly. Null for null."""
    kind = pa.struct([("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])
    plain = not (m := parse(model)).charsmap and not m.trim_spaces

    @arrow_udf(ENCODED)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for part in slices(batch, ENCODE_BYTES):
                texts = part.to_pylist()
                ids = encode_texts(model, texts, threads)
                back = decode_ids(model, ids, threads)
                same = [None if x is None else y == (x.replace(MARK, " ") if plain else expected(model, x)) for x, y in zip(texts, back, strict=True)]
                done.append(pa.StructArray.from_arrays([pa.array(ids, kind[0].type), pa.array(same, pa.bool_())], fields=list(kind), mask=pa.array([x is None for x in texts])))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    return encode(text)


def decoded(ids: Column, model: bytes, threads: int = 2) -> Column:
    """The text of token ids. Null for null."""

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = (batch.slice(at, ROWS).to_pylist() for at in range(0, len(batch), ROWS))
            yield pa.array([x for part in parts for x in decode_ids(model, part, threads)], pa.string())

    return decode(ids)


def encode(docs: DataFrame, *, model_path: str = DEFAULT_MODEL, text: str = "text", id_col: str = "doc_id", threads: int = 2) -> DataFrame:
    """One row per input row: id, ``token_ids``, ``n_tokens``, ``round_trip``. Null texts have nulls, empty ones no tokens.

    Whole texts are encoded, however long; repeated rows and null ids stay; other columns play no part.
    """
    e = docs.select(F.col(id_col).alias("id"), encoded(F.col(text), read_model(model_path), threads).alias("e"))
    return e.select(F.col("id").alias(id_col), "e.token_ids", F.when(F.col("e.token_ids").isNotNull(), F.size("e.token_ids")).cast("long").alias("n_tokens"), "e.round_trip")


def decode(rows: DataFrame, *, model_path: str = DEFAULT_MODEL, ids: str = "token_ids", id_col: str = "doc_id", threads: int = 2) -> DataFrame:
    """One row per input row: id, ``text``."""
    return rows.select(F.col(id_col).alias("id"), decoded(F.col(ids), read_model(model_path), threads).alias("text")).select(F.col("id").alias(id_col), "text")


def parity(data: bytes, texts: list[str], threads: int = 2) -> list[int]:
    """Places of the texts whose ids or decoded text differ from the sentencepiece library's."""
    import sentencepiece

    ours, s = encode_texts(data, texts, threads), sentencepiece.SentencePieceProcessor(model_proto=data)
    theirs = s.encode(texts, num_threads=threads)
    back = decode_ids(data, ours, threads)
    return [i for i, (a, b, c) in enumerate(zip(ours, theirs, back, strict=True)) if a != b or c != s.decode(b)]


def describe(path: str = DEFAULT_MODEL) -> str:
    """A model's settings as JSON."""
    m = parse(read_model(path))
    return json.dumps({"pieces": len(m.pieces), "kind": {UNIGRAM: "unigram", BPE: "bpe"}[m.kind], "byte_fallback": m.byte_fallback, "dummy_prefix": m.dummy_prefix, "trim_spaces": m.trim_spaces, "charsmap_bytes": len(m.charsmap)})
