"""Language-model scores: logistic mixing of hashed-context bit predictors, and a smoothed unigram base.

Training counts, over all training texts, how often each binary decision went either way after each hashed context. A text is coded
byte by byte (and an end) along code trees that depend on the byte before, so that likely bytes take few decisions. Each
decision is predicted in the logistic domain from several context orders at once; the predictions are mixed with weights
chosen by a gate, and each text refines the weights as it goes on: a block of decisions is scored first and learned from after.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_udf, held_out, settle, ship, slices, stage_table

#: Bytes of context of each hashed predictor. One more predictor is the code tree's own, by the byte before.
ORDERS = (3, 4, 6)
#: A table has a slot for so many training symbols, as a power of two between these: tables grow with the input up to what a task's memory takes.
SYMBOLS_A_SLOT, SLOT_BITS = 256, (16, 22)
INPUTS = len(ORDERS) + 1
PAD = max(ORDERS)
#: Slots of a table that travel together.
BLOCK = 1 << 16
#: Symbols of a text before the weights are refined first; each next block is twice as long.
FIRST_BLOCK = 32
#: Text that a task counts at least, as a multiple of the bytes of counts that it sends.
COUNTED = 16
#: How many of the commonest words have their counts with every task; the counts of all others come by a join.
COMMON = 1 << 18
#: Text turned into decisions at a time.
SCORE_BYTES = 1 << 18
#: Logits are kept as 16-bit integers of 1 / SCALE.
SCALE = 256
GATES, CLASSES = 8, 4
#: Weight of the prior when a text refines the weights.
PRIOR = 1500.0
#: Weights (of each predictor, and the bias) before anything is learned.
START = np.append(np.full(INPUTS, 0.4), 0.0)
END, SYMBOLS = 256, 257
_BYTE_CLASS = np.array([0 if b in b" \t\n\r\x0b\x0c\x00" else 1 if chr(b).isalpha() and b < 128 else 2 if b >= 128 else 3 for b in range(256)], np.int64)
_U32 = np.uint32
#: 0 for the white space that separates words, else the byte with A-Z lower-cased, plus one.
_WORD_BYTE = np.array([0 if b == 32 or 9 <= b <= 13 else 1 + (b + 32 if 65 <= b <= 90 else b) for b in range(256)], np.uint16)
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 20), b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts data[offsets[i]:offsets[i + 1]], and the first word of each text. 0 stands for no word."""
    low = _WORD_BYTE[data]
    n = len(low)
    inside = low != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    start[edges] = inside[edges]
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside
    stop[:-1] &= ~inside | start
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop)
    up, down = _powers(n + 1)[:2]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(low * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= (ends - starts).astype(np.uint64) << np.uint64(48)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    h[h == 0] = 1
    return h, np.searchsorted(starts, offsets)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)


@dataclass
class Symbols:
    """Texts as symbols: each has PAD zero bytes before it and an end behind it. ``at``: places of what is coded, ``of``: its text, ``block``: its block.

    What is coded comes block by block, in each block text by text, so that a block of all texts is one slice of every array.
    """

    codes: np.ndarray
    at: np.ndarray
    of: np.ndarray
    block: np.ndarray

    @classmethod
    def build(cls, data: np.ndarray, offsets: np.ndarray, blocks: bool = True) -> Symbols:
        """Without ``blocks`` each text is one block, and comes whole."""
        n = len(offsets) - 1
        coded = np.diff(offsets) + 1
        of = np.repeat(np.arange(n, dtype=np.int32), coded)
        inner = np.arange(len(of)) - np.repeat(offsets[:-1] + np.arange(n), coded)
        at = np.arange(len(of)) + PAD * (of + 1)
        codes = np.zeros(len(of) + PAD * n, np.int16)
        ends = np.cumsum(coded) - 1
        codes[at[ends]] = END
        body = np.ones(len(of), bool)
        body[ends] = False
        codes[at[body]] = data
        if not blocks:
            return cls(codes, at, of, np.zeros(len(of), np.int8))
        most = int(coded.max(initial=1)).bit_length() + 1
        block = np.searchsorted(FIRST_BLOCK * (2 ** np.arange(1, most) - 1), inner, side="right").astype(np.int8)
        order = np.argsort(block, kind="stable")
        return cls(codes, at[order], of[order], block[order])


def huffman(counts: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """For each symbol its decisions: inner nodes from the root on, and the branch taken at each. Nodes are numbered from the root."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    n, kids = len(heap), {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        kids[n] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], n, n))
        n += 1
    out: list[tuple[list[int], list[int]]] = [([], [])] * len(counts)
    waiting = [(heap[0][2], [], [])]
    while waiting:
        node, nodes, bits = waiting.pop()
        if node not in kids:
            out[node] = (nodes, bits)
            continue
        own = n - 1 - node
        for bit, kid in enumerate(kids[node]):
            waiting.append((kid, [*nodes, own], [*bits, bit]))
    return out


class Trees:
    """The code trees after each byte, as flat arrays."""

    def __init__(self, bigrams: np.ndarray):
        self.start, self.length, nodes, bits = np.zeros((256, SYMBOLS), np.int32), np.zeros((256, SYMBOLS), np.int32), [], []
        at = 0
        plain = huffman(bigrams.sum(0))
        for before in range(256):
            code = huffman(bigrams[before]) if bigrams[before].any() else plain
            for symbol, (n, b) in enumerate(code):
                self.start[before, symbol], self.length[before, symbol] = at, len(n)
                at += len(n)
                nodes += n
                bits += b
        self.nodes, self.bits = np.array(nodes, np.uint32), np.array(bits, np.uint8)
        # a decision's place in these arrays tells the byte before, so its gate and what the counts after that byte say of it are arrays too
        sizes = self.length.ravel()
        before = np.repeat(np.repeat(np.arange(256), SYMBOLS), sizes)
        depth = np.arange(at) - np.repeat(self.start.ravel(), sizes)
        self.gates = (np.minimum(depth, GATES - 1) * CLASSES + _BYTE_CLASS[before]).astype(np.intp)  # what is looked up with is kept as numpy indexes it
        took, n = np.zeros((256 * SYMBOLS, 2)), np.repeat(bigrams.ravel(), sizes)
        of = before * SYMBOLS + self.nodes
        for bit in (0, 1):
            took[:, bit] = np.bincount(of, weights=n * (self.bits == bit), minlength=len(took))
        self.logits = logits(took)[of].astype(np.float32)
        self.mixed = self.nodes * _U32(0x9E3779B1)


@dataclass
class Decisions:
    """All binary decisions of some texts, in the symbols' order. Run r, of text ``text[r]`` in block ``block[r]``, is decisions bounds[r] up to bounds[r + 1]."""

    slots: list[np.ndarray]
    code: np.ndarray  # places in the trees' arrays
    bits: np.ndarray
    text: np.ndarray
    block: np.ndarray
    bounds: np.ndarray


def slot_bits(symbols: int) -> int:
    """The power of two of a table's slots for so many training symbols."""
    return min(max((symbols // SYMBOLS_A_SLOT).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])


def decisions(s: Symbols, trees: Trees, bits: int) -> Decisions:
    flat = s.codes[s.at - 1].astype(np.int32) * SYMBOLS + s.codes[s.at]
    length = trees.length.ravel()[flat]
    last = np.cumsum(length)
    code = np.repeat(trees.start.ravel()[flat] - (last - length), length).astype(np.intp, copy=False)
    code += np.arange(len(code))
    node = np.take(trees.mixed, code, mode="clip")
    slots = []
    c = s.codes.astype(np.uint32) + _U32(1)
    h = np.zeros(len(s.at), np.uint32)
    for back in range(1, PAD + 1):
        h = h * _U32(0x2C1B3C6D) + c[s.at - back]
        if back in ORDERS:
            mixed = np.repeat((h ^ (h >> _U32(15))) * _U32(0x85EBCA6B), length)
            mixed += node
            mixed *= _U32(0xC2B2AE35)
            mixed >>= _U32(32 - bits)
            slots.append(mixed)
    run = np.flatnonzero(np.concatenate([[True], (s.of[1:] != s.of[:-1]) | (s.block[1:] != s.block[:-1])])) if len(flat) else np.array([], np.int64)
    return Decisions(slots, code, np.take(trees.bits, code, mode="clip"), s.of[run], s.block[run], np.append((last - length)[run], len(code)))


@dataclass
class Mixer:
    """What a text's probability is taken from: trees, a table of logits for each order, weights for each gate. Its size is bounded by SLOT_BITS."""

    trees: Trees
    tables: list[np.ndarray]
    weights: np.ndarray  # gates x (predictors + 1)

    def __post_init__(self) -> None:
        w, g = self.weights, self.trees.gates
        self.of_tree = (w[:, -1][g] + w[:, 0][g] * self.trees.logits / SCALE).astype(np.float32)  # bias and the tree's own share of a logit
        self.bits = (len(self.tables[0]) - 1).bit_length()

    def inputs(self, d: Decisions) -> list[np.ndarray]:
        """The predictors' logits, in units of 1 / SCALE."""
        return [np.take(self.trees.logits, d.code, mode="clip"), *(np.take(t, i, mode="clip").astype(np.float32) for t, i in zip(self.tables, d.slots, strict=True))]

    def log10(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text with its end."""
        n = len(offsets) - 1
        d = decisions(Symbols.build(data, offsets), self.trees, self.bits)
        x = self.inputs(d)
        gates, w = np.take(self.trees.gates, d.code, mode="clip"), np.ascontiguousarray((self.weights / SCALE).astype(np.float32).T)
        z = np.take(self.of_tree, d.code, mode="clip")
        share = np.empty_like(z)
        for k, v in enumerate(x[1:], 1):
            np.take(w[k], gates, out=share, mode="clip")
            share *= v
            z += share
        sign = np.float32(1) - np.float32(2) * d.bits
        total, change, spread = np.zeros(n), np.zeros((INPUTS, n)), np.zeros((INPUTS, n))
        size = np.bincount(d.text, minlength=n)  # blocks of each text
        edges = np.searchsorted(d.block, np.arange(int(d.block.max(initial=-1)) + 2))
        for block, (r, q) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            lo, hi, live = d.bounds[r], d.bounds[q], d.text[r:q]
            starts, counts = d.bounds[r:q] - lo, np.diff(d.bounds[r : q + 1])
            own = z[lo:hi]
            if block:
                for k, v in enumerate(x):
                    moved = np.repeat((change[k, live] / SCALE).astype(np.float32), counts)
                    moved *= v[lo:hi]
                    own += moved
            s = sign[lo:hi] * own
            e = np.exp(-np.abs(s))
            total[live] += np.add.reduceat(np.maximum(s, 0) + np.log(e + np.float32(1)), starts, dtype=np.float64)
            if (size[live] > block + 1).any():  # learn from the block for what follows
                p = np.where(s > 0, np.float32(1), e) / (1 + e)  # of the branch not taken
                slope, step = p * (1 - p), -sign[lo:hi] * p
                for k, v in enumerate(x):
                    of_block = v[lo:hi]
                    pull = np.add.reduceat(step * of_block, starts) / SCALE
                    of_block = of_block * of_block
                    of_block *= slope
                    spread[k, live] += np.add.reduceat(of_block, starts) / SCALE**2
                    change[k, live] += pull / (spread[k, live] + PRIOR)
        return -total / np.log(10)


def fit_weights(trees: Trees, tables: list[np.ndarray], texts: list[str]) -> np.ndarray:
    """Weights of each gate by Newton's method on texts whose own counts aren't in the tables; a gate without texts sums the logits by equal shares.

    What they are used for is a start: ``refitted`` takes them on with all training texts.
    """
    gates, k = GATES * CLASSES, INPUTS + 1
    w = np.tile(START, (gates, 1))
    mixer = Mixer(trees, tables, w)
    parts = []
    for at in range(0, len(texts), 64):
        d = decisions(Symbols.build(*joined(texts[at : at + 64])), trees, mixer.bits)
        parts.append((trees.gates[d.code].astype(np.uint8), d.bits, [v.astype(np.int16) for v in mixer.inputs(d)]))
    for _ in range(10):
        hessian, gradient = np.zeros((k, k, gates)), np.zeros((k, gates))
        for g, bits, own in parts:
            x = [*(v.astype(np.float32) / SCALE for v in own), np.ones(len(bits), np.float32)]
            z = sum(w[:, i][g] * v for i, v in enumerate(x))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            for i in range(k):
                gradient[i] += np.bincount(g, weights=(bits - p) * x[i], minlength=gates)
                for j in range(i + 1):
                    hessian[i, j] += np.bincount(g, weights=p * (1 - p) * x[i] * x[j], minlength=gates)
        w += newton_step(hessian, gradient, w)
    return w


def newton_step(hessian: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The step of each gate from weights ``w``; of the Hessian's entries (k x k x gates) those up to the diagonal count."""
    k = len(gradient)
    out = np.zeros_like(w)
    for g in range(len(w)):
        h = np.tril(hessian[:, :, g]) + np.tril(hessian[:, :, g], -1).T + 20 * np.eye(k)
        step = np.linalg.solve(h, gradient[:, g] - 20 * (w[g] - START))
        out[g] = step * min(1.0, 0.3 / max(1e-9, float(np.abs(step).max())))  # whole Newton steps may run away from a bad start
    return out


def without_itself(counts: np.ndarray) -> np.ndarray:
    """``logits`` for the decisions that were counted, each without itself: of each slot for those that took the first branch, then the second."""
    counts = counts.reshape(-1, 2)
    out = np.empty(counts.shape, np.int16)
    for at in range(0, len(counts), BLOCK):
        n = counts[at : at + BLOCK].astype(np.float64)
        left = np.maximum(n - 1, 0) + 0.3
        first, second = np.log((n[:, 1] + 0.3) / left[:, 0]), np.log(left[:, 1] / (n[:, 0] + 0.3))
        out[at : at + BLOCK] = np.round(np.clip(np.stack([first, second], axis=1), -15, 15) * SCALE)
    return out.reshape(-1)


class Slope:
    """First and second derivatives of the training texts' log-probability by the gates' weights, added up. Tables are those of ``without_itself``."""

    def __init__(self, trees: Trees, tables: list[np.ndarray], weights: np.ndarray):
        self.trees, self.tables, self.weights = trees, tables, weights.astype(np.float32)
        self.bits = (len(tables[0]) - 1).bit_length() - 1
        k, gates = INPUTS + 1, GATES * CLASSES
        self.hessian, self.gradient = np.zeros((k, k, gates)), np.zeros((k, gates))

    def add(self, texts: list[str]) -> None:
        d = decisions(Symbols.build(*joined(texts), blocks=False), self.trees, self.bits)
        gate = np.take(self.trees.gates, d.code, mode="clip").astype(np.uint8)
        order = np.argsort(gate, kind="stable")
        edges = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=len(self.weights)))])
        taken = np.take(d.bits, order)
        x = np.empty((INPUTS + 1, len(order)), np.float32)
        x[0] = np.take(self.trees.logits, np.take(d.code, order), mode="clip")
        x[-1] = SCALE
        for k, (table, slots) in enumerate(zip(self.tables, d.slots, strict=True), 1):
            x[k] = np.take(np.take(table, (slots << _U32(1)) | d.bits, mode="clip"), order)
        x *= np.float32(1 / SCALE)
        for g, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                own = x[:, a:b]
                p = 1 / (1 + np.exp(-np.clip(self.weights[g] @ own, -30, 30)))
                self.gradient[:, g] += own @ (taken[a:b] - p)
                p *= 1 - p
                self.hessian[:, :, g] += (own * p) @ own.T


def _added(table: pa.Table) -> pa.Table:
    return pa.table({n: pa.array([sum(np.frombuffer(b.as_buffer()) for b in table.column(n)).tobytes()], pa.binary()) for n in ("hessian", "gradient")})


def refitted(texts: DataFrame, trees: Trees, counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weights after a Newton step by all rows of ``texts`` (one text column), those that were counted. The driver gets FAN_IN rows of a few kilobytes at most."""
    ship(texts.sparkSession)
    shared = texts.sparkSession.sparkContext.broadcast((trees, [without_itself(c) for c in counts], weights))
    settle()

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slope = None
        for batch in batches:
            for part in slices(batch.column(0), SCORE_BYTES):
                slope = slope or Slope(*shared.value)
                slope.add(part.to_pylist())
        if slope:
            yield pa.record_batch([pa.array([slope.hessian.tobytes()], pa.binary()), pa.array([slope.gradient.tobytes()], pa.binary())], names=["hessian", "gradient"])

    kind = "hessian binary, gradient binary"
    rows = texts.mapInArrow(slopes, kind).withColumn("task", F.pmod(F.spark_partition_id(), F.lit(FAN_IN))).groupBy("task").applyInArrow(_added, kind).collect()
    shared.destroy()
    if not rows:
        return weights
    k = INPUTS + 1
    hessian, gradient = (sum(np.frombuffer(r[n]) for r in rows) for n in ("hessian", "gradient"))
    return weights + newton_step(hessian.reshape(k, k, -1), gradient.reshape(k, -1), weights)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (kind, key, n): kind 0 words by hash, with the ends of texts as word 0; kind 1 pairs of a byte and the symbol behind it."""
    pairs = np.zeros(256 * SYMBOLS, np.int64)
    ends = 0
    held: list[np.ndarray] = []

    def row(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    for batch in batches:
        for part in slices(batch.column(0), 1 << 20):
            data, offsets = joined(part.to_pylist())
            s = Symbols.build(data, offsets)
            pairs += np.bincount(s.codes[s.at - 1].astype(np.int64) * SYMBOLS + s.codes[s.at], minlength=len(pairs))
            ends += len(part)
            held.append(word_hashes(data, offsets)[0])
            if sum(map(len, held)) > 2_000_000:
                yield row(0, *np.unique(np.concatenate(held), return_counts=True))
                held = []
    if held:
        yield row(0, *np.unique(np.concatenate(held), return_counts=True))
    if ends:
        yield row(0, np.array([0]), np.array([ends]))
        yield row(1, at := np.flatnonzero(pairs), pairs[at])


def tallies(texts: list[str], trees: Trees, bits: int, counts: np.ndarray, change: np.ufunc = np.add) -> None:
    """Adds to ``counts`` (orders x 2 a slot) how often the texts' decisions went either way, or takes it from them."""
    d = decisions(Symbols.build(*joined(texts)), trees, bits)
    for own, slots in zip(counts, d.slots, strict=True):
        change.at(own, (slots << _U32(1)) | d.bits, _U32(1))


def _tallied(trees: Broadcast, bits: int):
    """Texts to (part, block, blob): how often decisions went either way, by slot; part is the order's number."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            for part in slices(batch.column(0), SCORE_BYTES):
                if counts is None:
                    counts = np.zeros((len(ORDERS), 2 << bits), np.uint32)
                tallies(part.to_pylist(), trees.value, bits, counts)
        if counts is not None:
            for i, own in enumerate(counts):
                for b in range(0, len(own), 2 * BLOCK):
                    yield pa.record_batch([pa.array([i], pa.int32()), pa.array([b // (2 * BLOCK)], pa.int32()), pa.array([own[b : b + 2 * BLOCK].tobytes()], pa.binary())], names=["part", "block", "blob"])

    return tally


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(2 * BLOCK, np.uint64)
    for blob in table.column("blob"):
        total += np.frombuffer(blob.as_buffer(), np.uint32)
    return pa.table({"part": table.column("part")[:1].cast(pa.int32()), "block": table.column("block")[:1].cast(pa.int32()), "blob": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})


def logits(counts: np.ndarray) -> np.ndarray:
    """The logit of the second branch from counts of both, as 16-bit integers of 1 / SCALE; 0 where nothing was counted."""
    counts = counts.reshape(-1, 2)
    out = np.empty(len(counts), np.int16)
    for at in range(0, len(counts), BLOCK):  # tables are large, and the driver makes them
        n = counts[at : at + BLOCK].astype(np.float64)
        out[at : at + BLOCK] = np.round(np.clip(np.log((n[:, 1] + 0.3) / (n[:, 0] + 0.3)), -15, 15) * SCALE)
    return out


#: Blobs that one task adds up; more go through another round.
FAN_IN = 64
#: Characters of a text that may be in the sample for the start of the gate weights.
FIT_CHARS = 20_000


def context_counts(texts: DataFrame, trees: Trees, bits: int, size: int = 0) -> np.ndarray:
    """Counts (orders x 2 a slot) of all rows of ``texts`` (one text column) of ``size`` bytes or so. The driver gets tables of bounded size.

    Each task sends one set of counts, whatever it read, so a task reads COUNTED times the bytes that it sends, or a share of the input if there are few tasks.
    """
    spark = texts.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(trees)
    sent = len(ORDERS) * 8 << bits
    tasks = max(1, min(texts.rdd.getNumPartitions(), max(2 * spark.sparkContext.defaultParallelism, -(-size // (COUNTED * sent)))))
    blobs = texts.coalesce(tasks).mapInArrow(_tallied(shared, bits), "part int, block int, blob binary")
    blobs = blobs.withColumn("task", F.spark_partition_id())
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        blobs = blobs.withColumn("task", F.pmod("task", F.lit(tasks))).groupBy("part", "block", "task").applyInArrow(_with_task, "part int, block int, blob binary, task int")
    counts = np.zeros((len(ORDERS), 2 << bits), np.uint32)
    for r in blobs.drop("task").groupBy("part", "block").applyInArrow(_summed, "part int, block int, blob binary").toLocalIterator():
        counts[r["part"], 2 * r["block"] * BLOCK : 2 * (r["block"] + 1) * BLOCK] = np.frombuffer(r["blob"], np.uint32)
    return counts


def _with_task(table: pa.Table) -> pa.Table:
    return _summed(table).append_column("task", table.column("task")[:1].cast(pa.int32()))


@dataclass
class LanguageModel:
    """``words``: (key, n) of all training words by hash, on the executors; the rest is of fixed size."""

    words: DataFrame
    train_tokens: int
    distinct: int
    common: tuple[np.ndarray, np.ndarray]
    end_count: int
    mixer: Mixer


def train(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", folds: int = 7, fold: int = 2, fit_rows: int = 400) -> LanguageModel:
    """Learns from all rows outside the held-out fold. Null texts count as empty ones.

    Word counts, byte pairs, context counts and gate weights cover every training text. The weights are those after a Newton step by all training texts,
    each decision predicted by tables without itself, which would else look better than they are; the step's start is fitted on ``fit_rows`` training rows with the least hashes.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(~held_out(F.col("id"), folds, fold))
    counted = stage_table(rows.select("text").mapInArrow(_counted, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    bigrams = np.zeros((256, SYMBOLS), np.int64)
    for r in counted.filter("kind = 1").collect():  # 65,792 pairs at most
        bigrams[divmod(r["key"], SYMBOLS)] = r["n"]
    words = counted.filter("kind = 0").select("key", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("key") == 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    keys, n = _common(words)
    trees, symbols = Trees(bigrams), int(bigrams.sum())
    bits = slot_bits(symbols)
    counts = context_counts(rows.select("text"), trees, bits, symbols)
    # fit_rows rows at most, of FIT_CHARS characters at most: where the step by all rows starts from
    sample = [r["text"] for r in rows.filter(F.length("text") <= FIT_CHARS).orderBy(F.xxhash64("id", "text", F.lit(31)), "id").limit(fit_rows).select("text").collect()]
    weights = fit_weights(trees, tables_without(sample, trees, bits, counts), sample)
    weights = refitted(rows.select("text"), trees, counts, weights)
    tables = [logits(c) for c in counts]
    del counts
    settle()
    return LanguageModel(words, total["n"], total["v"], (keys, n), total["ends"], Mixer(trees, tables, weights))


def tables_without(sample: list[str], trees: Trees, bits: int, counts: np.ndarray) -> list[np.ndarray]:
    """Tables of logits without what the sample's texts, which are among those counted, have in the counts. The counts are the same after as before: there is no second set of them."""
    parts = [sample[at : at + 64] for at in range(0, len(sample), 64)]
    for part in parts:
        tallies(part, trees, bits, counts, np.subtract)
    tables = [logits(c) for c in counts]
    for part in parts:
        tallies(part, trees, bits, counts)
    return tables


def _common(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and counts of the commonest words: all with a count so high that COMMON words at most have it.

    The count is found from a histogram of bounded size, so no task and not the driver gets more than COMMON rows.
    """
    bucket = F.floor(F.log2("n") * 32).cast("int")
    least, seen = None, 0
    for r in sorted(words.filter("key <> 0").groupBy(bucket.alias("b")).count().collect(), key=lambda r: -r["b"]):  # some 2,000 rows at most
        seen += r["count"]
        if seen > COMMON:
            break
        least = r["b"]
    if least is None:
        return np.array([], np.uint64), np.array([], np.int64)
    top = words.filter((F.col("key") != 0) & (bucket >= least)).toArrow()
    keys, n = top.column("key").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


class Lookup:
    """Places of hashes in an ascending array, by their leading bits."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        self.first = np.searchsorted(keys >> np.uint64(64 - self.BITS), np.arange((1 << self.BITS) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if it isn't there."""
        head = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        out = np.full(len(h), -1, np.int32)
        for _ in range(self.deepest):
            hit = (self.keys[at] == h) & (at < end)
            out[hit] = at[hit]
            at = np.minimum(at + 1, len(self.keys) - 1)
        return out


SCORED = "struct<n_tokens: bigint, n_bytes: bigint, n_known: bigint, log_sum: double, log_p: double, rare: array<struct<key: bigint, n: int>>>"


def _scored(text: Column, shared: Broadcast) -> Column:
    """Of each text: tokens, bytes; known tokens and the sum of log10(c + 1) among the common words; the model's log10; all other words with how often they stand in it."""

    @arrow_udf(SCORED)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mixer, (keys, counts), ends = shared.value
        gain, lookup = np.log10(counts + 1.0), Lookup(keys)
        end_gain = np.log10(ends + 1.0)
        for batch in batches:
            done = []
            for part in slices(batch, SCORE_BYTES):
                data, offsets = joined(part.to_pylist())
                h, first = word_hashes(data, offsets)
                n = len(part)
                of = np.repeat(np.arange(n), np.diff(first))
                at = lookup.find(h)
                hit = at >= 0
                known = np.bincount(of[hit], minlength=n) + (ends > 0)
                log_sum = np.bincount(of[hit], weights=gain[at[hit]], minlength=n) + end_gain
                o, r = of[~hit], h[~hit]
                order = np.lexsort((r, o))
                o, r = o[order], r[order]
                new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (r[1:] != r[:-1])])) if len(o) else np.array([], np.int64)
                times = np.diff(np.append(new, len(o)))
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(o[new], np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(r[new].view(np.int64)), pa.array(times.astype(np.int32))], names=["key", "n"]))
                columns = [pa.array((np.diff(first) + 1).astype(np.int64)), pa.array(np.diff(offsets)), pa.array(known.astype(np.int64)), pa.array(log_sum), pa.array(mixer.log10(data, offsets)), rare]
                done.append(pa.StructArray.from_arrays(columns, names=["n_tokens", "n_bytes", "n_known", "log_sum", "log_p", "rare"]))
            yield pa.concat_arrays(done) if done else pa.array([], pa.struct([("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("n_known", pa.int64()), ("log_sum", pa.float64()), ("log_p", pa.float64()), ("rare", pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int32())])))]))

    return score(text)


def score(docs: DataFrame, model: LanguageModel, *, text: str = "text", id_col: str = "doc_id", folds: int = 7, fold: int = 2) -> DataFrame:
    """One row per input row: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    Null texts are empty ones: one token, the end. Repeated rows and null ids stay apart; an empty table gives an empty result; with nothing to learn from
    no token is known and the base is that of N = V = 0. Counts of the COMMON commonest words travel with the tasks; all other words of a text are joined with
    the full table of counts, so a hot word never meets in one task and no count is left out. Other columns play no part.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.mixer, model.common, model.end_count))
    rows = docs.select(F.col(id_col).alias("id"), _scored(F.coalesce(F.col(text), F.lit("")), shared).alias("s"), F.monotonically_increasing_id().alias("row"))
    rows = stage_table(rows.select("row", "id", "s.*"), "scored")
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", F.col("r.key").alias("key"), F.col("r.n").alias("times"))
    found = rare.join(model.words, "key").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_sum"))
    out = rows.drop("rare").join(found, "row", "left")
    smooth = F.log10(F.lit(float(model.train_tokens + model.distinct + 1)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select(
        F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), "n_tokens", (F.col("n_known") + zero("more_known")).cast("bigint").alias("n_known"),
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"), (F.col("log_sum") + zero("more_sum") - F.col("n_tokens") * smooth).alias("base_score"),
        F.col("log_p").alias("score"), (-F.col("log_p") / F.log10(F.lit(2.0)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )
