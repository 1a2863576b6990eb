"""Benchmark decontamination: CGK embeddings, repeated bit sampling over item-sized windows, exact edit verification.

The CGK walk reads a window of words and writes one word a step; after each step it moves on by a random bit that depends on
the step and the word. Two windows within few edits walk apart at an edit and soon meet again, so that edit distance
becomes Hamming distance of what is written. Keys made of a few sampled steps find windows that agree in them; each is
then checked by an exact edit distance against the text around it. Windows of characters are walked as well, as edits of a fifth of
the characters leave few words whole; their sampling is repeated until copies edited as much as is allowed are found with the recall asked for.
Items and texts are normalised alike before any window is cut, so case, punctuation and kinds of space don't count as edits.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_udf, free_name, lowered, slices

#: Window sizes in words. An item takes the largest that leaves STRIDE windows in it (longer items several),
#: and the size FINE as well, for items whose words are edited all over.
SIZES, FINE = (1, 4, 8, 12, 24, 48), 8
#: Windows of a document begin at every STRIDE-th word; an item has one at each of its words, so that one of STRIDE meets a document's.
STRIDE = 4
#: Size of the windows of characters, which find items whose words are edited all over; a document's begin at every CHAR_STRIDE-th character. Their walks and
#: the steps sampled by a key. The number of keys follows from the recall; there are MOST_KEYS at most.
CHARS, CHAR_STRIDE, CHAR_WALKS, CHAR_SAMPLED, MOST_KEYS = 16, 4, 1, 18, 24
#: Share of copies with EDITS of their characters changed at random that candidates are to have, and how many copies tell.
RECALL, COPIES = 0.95, 400
#: Items of so many characters need no windows of FINE words besides.
LONG = 160
#: Independent walks; keys of each for each size; steps sampled by a key, and by one of the size FINE, whose few words are oftener met by chance.
WALKS, KEYS, SAMPLED, FINE_SAMPLED = 2, 6, 5, 8
#: Edits allowed, as a share of the item's characters.
EDITS = 0.2
#: Bytes of documents walked at a time, and of items that one pass over the documents looks for.
WALK_BYTES, ITEM_BYTES = 1 << 20, 2 << 20
WORDS = re.compile(r"\w+")
PRIME = (1 << 61) - 1

_U, _U32 = np.uint64, np.uint32
#: 0 for what separates words (ASCII white space, controls and punctuation), else the byte with A-Z lower-cased.
_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() or b == 95 else 0 for b in range(256)], np.uint8)

#: A hash of each byte.
_CHAR = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, np.uint64) * _U(2) + _U(1)


#: For each ASCII byte itself in lower case if words are made of it, else a space.
_ASCII = bytes(b + 32 if 65 <= b <= 90 else b if b < 128 and (chr(b).isalnum() or b == 95) else 32 for b in range(256))


def normalized(text: str) -> str:
    """The words in lower case with one space between."""
    if text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split()).decode()
    return " ".join(WORDS.findall(lowered(text)))


def edited(text: str, share: float, rng: np.random.Generator) -> str:
    """The text with so large a share of its characters replaced, deleted or followed by another, at random."""
    c = list(text)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for p in rng.permutation(len(c))[: int(share * len(c))]:
        x = letters[rng.integers(26)]
        c[p] = (x, "", c[p] + x)[rng.integers(3)]
    return "".join(c)


@dataclass
class Words:
    """The words of a batch of texts: their hashes, bytes [start, end) in the batch, and the first word of each text."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


_POWERS: tuple[np.ndarray, np.ndarray] | None = None
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64."""
    global _POWERS
    if _POWERS is None or len(_POWERS[0]) < n:
        n = max(n, 1 << 20)
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.empty(n, _U)
            p[0] = 1
            filled = 1
            while filled < n:  # doubled each time
                more = min(filled, n - filled)
                p[filled : filled + more] = p[:more] * _U(pow(b, filled, 1 << 64))
                filled += more
            out.append(p)
        _POWERS = (out[0], out[1])
    return _POWERS


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]; a word never spans two texts."""
    low = _BYTE[data]
    n = len(low)
    inside = low != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = offsets[:-1][(offsets[:-1] < n)]
    start[edges] = inside[edges]
    stop = np.zeros(n + 1, bool)
    stop[1:] = inside
    stop[:-1] &= ~inside | start
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((low.astype(_U) + _U(1)) * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    return Words(h, starts, ends, np.searchsorted(starts, offsets))


def chars_of(data: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, each word followed by one 0 (if anything is between it and the next) and each text by as many as a walk may read; the word of each; where each text begins and the next would."""
    low = _BYTE[data]
    kept = low != 0
    kept[w.end[w.end < len(low)]] = True
    marks = np.zeros(len(low), np.int32)
    marks[w.start] = 1
    at = np.flatnonzero(kept)
    first = np.searchsorted(at, np.append(w.start, len(low))[w.first])
    gap = 2 * CHARS
    to = np.arange(len(at)) + gap * np.repeat(np.arange(len(first) - 1), np.diff(first))
    chars, word = np.zeros(len(at) + gap * (len(first) - 1), np.uint8), np.zeros(len(at) + gap * (len(first) - 1), np.int32)
    chars[to] = low[at]
    word[to] = np.cumsum(marks, dtype=np.int32)[at] - 1
    return chars, word, first + gap * np.arange(len(first))


def char_windows(first: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of characters begin in texts that chars_of has laid out, at every ``stride``-th character, and the text of each."""
    size = np.diff(first) - 2 * CHARS
    n = np.maximum(0, (size - CHARS) // stride + 1) * (size >= CHARS)
    text = np.repeat(np.arange(len(n)), n)
    return first[text] + stride * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)), text


def myers(pattern: str, text: str, most: int | None = None) -> tuple[int, int]:
    """The least edit distance of the pattern to any part of the text, and where the first such part ends. Bit-parallel, exact.

    It stops early where no part can be within ``most`` any more; the distance is then some greater number.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = mask, 0, m
    best, at = m, 0
    get, last = peq.get, len(text) - 1
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ((xh | pv) ^ mask) & mask, pv & xh
        if ph & high:
            score += 1
            if most is not None and best > most and score - (last - j) > most:  # a character lowers the score by one at most
                break
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, j + 1
        ph = ph << 1 & mask
        pv, mv = mh << 1 & mask | (xv | ph) ^ mask, ph & xv
    return best, at


#: Characters of a piece of an item: what one machine word holds. Values that characters are told apart by: ASCII, and 64 for all others.
PIECE, CODES = 64, 192
#: Pieces that are compared with their stretches of text at once, and items whose pieces a worker keeps.
PIECES, KEPT_ITEMS = 2048, 4096


def char_codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each character of UTF-8 bytes, and the character that each byte belongs to. Different characters may share a code."""
    first = (data & np.uint8(0xC0)) != np.uint8(0x80)
    at = np.flatnonzero(first)
    lead = data[at].astype(np.int64)
    behind = data[np.minimum(at + 1, max(0, len(data) - 1))] & np.uint8(63)
    return np.where(lead < 128, lead, 128 + behind).astype(np.uint8), np.cumsum(first) - 1


def piece_masks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece of an item: for each code the places that have it, as bits; and the bit of its last place."""
    n = -(-len(codes) // PIECE)
    masks = np.zeros((n, CODES), np.uint64)
    place = np.arange(len(codes))
    np.bitwise_or.at(masks, (place // PIECE, codes), _U(1) << (place % PIECE).astype(np.uint64))
    sizes = np.minimum(PIECE, len(codes) - PIECE * np.arange(n))
    return masks, _U(1) << (sizes - 1).astype(np.uint64)


def least_distances(masks: np.ndarray, last: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each piece its least edit distance to any part of codes[begin:end], all pieces at once: bit-parallel, a step for each character of the longest stretch."""
    order = np.argsort(end - begin, kind="stable")  # stretches that have ended are at the front, so that a step takes what is behind them
    begin, last, row = begin[order], last[order], order * CODES
    size = end[order] - begin
    ended = np.searchsorted(size, np.arange(int(size.max(initial=0))), side="right").tolist()
    flat, codes = masks.ravel(), codes.astype(np.intp)
    pv, mv = np.full(len(begin), ~_U(0)), np.zeros(len(begin), np.uint64)
    score = np.bitwise_count(last - _U(1)).astype(np.int64) + 1
    best = score.copy()
    room = [np.empty(len(begin), np.uint64) for _ in range(3)]
    at, place = begin.astype(np.intp), np.empty(len(begin), np.intp)
    done = None
    for k in ended:
        if k != done:  # the arrays without what has ended
            p, m, sc, be, la, ro, where, to, eq, xh, t = (x[k:] for x in (pv, mv, score, best, last, row, at, place, *room))
            done = k
        np.take(codes, where, out=to, mode="clip")
        to += ro
        where += 1
        np.take(flat, to, out=eq, mode="clip")
        np.bitwise_and(eq, p, out=xh)
        xh += p
        xh ^= p
        xh |= eq
        eq |= m  # xv
        np.bitwise_or(xh, p, out=t)
        np.invert(t, out=t)
        t |= m  # ph
        p &= xh  # mh
        sc += (t & la) != 0
        sc -= (p & la) != 0
        np.minimum(be, sc, out=be)
        t <<= _U(1)
        p <<= _U(1)
        np.bitwise_and(t, eq, out=m)
        eq |= t
        np.invert(eq, out=eq)
        p |= eq
    out = np.empty_like(best)
    out[order] = best
    return out


@dataclass
class Index:
    """Keys of all windows of a bounded set of items. It is shipped as the items' texts and built where it is used."""

    items: list[tuple[int | None, str]]
    seed: int = 7
    edits: float = EDITS
    recall: float = RECALL
    keys: int | None = None
    ready: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"items": self.items, "seed": self.seed, "edits": self.edits, "recall": self.recall, "keys": self.fitted().keys, "ready": {}}

    def fitted(self) -> Index:
        """With the least number of keys of character windows (``keys``) that finds the share ``recall`` of copies edited up to the limit."""
        if self.keys is not None:
            return self
        if not self.items:
            self.keys = 1
            return self
        trial = Index(self.items, self.seed, self.edits, self.recall, MOST_KEYS)
        normal = trial.build()["normal"]
        rng = np.random.Generator(np.random.PCG64(self.seed + 1))
        own = np.resize(rng.permutation(len(self.items)), min(COPIES, 20 * len(self.items)))
        first = np.full(len(own), MOST_KEYS + 1)
        texts = [edited(normal[i], self.edits, rng) for i in own]
        for name, text, item, _ in trial.candidates([normalized(t).encode() for t in texts]):
            hit = text[own[text] == item]
            first[hit] = np.minimum(first[hit], 0 if name[1] else name[2] + 1)
        found = np.searchsorted(np.sort(first), np.arange(MOST_KEYS + 1), side="right") / len(own)
        enough = np.flatnonzero(found >= self.recall)
        self.keys = max(1, int(enough[0])) if len(enough) else MOST_KEYS
        return self

    def build(self) -> dict:
        if self.ready:
            return self.ready
        self.fitted()
        normal = [normalized(t) for _, t in self.items]
        texts = [t.encode("utf-8", "surrogatepass") for t in normal]
        data = np.frombuffer(b"".join(texts), np.uint8)
        w = words_of(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        counts = np.diff(w.first)
        found = counts[counts > 0]
        stride = STRIDE if len(found) and found.min() >= 2 * STRIDE - 1 else 1
        fits = {i: [s for s in SIZES if s <= max(1, n - stride + 1)] for i, n in enumerate(counts) if n}
        sizes = {i: {f[-1]} if len(texts[i]) >= LONG else {f[-1], min(f[-1], FINE)} for i, f in fits.items()}
        self.ready = {"stride": stride, "sizes": sorted(set().union(*sizes.values())), "normal": normal, "words": counts, "pieces": {}}
        rng = np.random.Generator(np.random.PCG64(self.seed))
        steps = 2 * max([CHARS, *self.ready["sizes"]])
        turn = rng.integers(1, 1 << 63, (WALKS, steps), np.uint64) | _U(1)
        sampled = {}
        for walk in range(WALKS):
            for s in SIZES:
                for k in range(KEYS):
                    at = np.sort(rng.permutation(max(1, 2 * s))[: FINE_SAMPLED if s == FINE else SAMPLED])
                    sampled[walk, s, k] = (at, rng.integers(1, 1 << 63, len(at), np.uint64) | _U(1), _U(rng.integers(1, 1 << 63)))
        for walk in range(CHAR_WALKS):
            for k in range(self.keys):
                at = np.sort(rng.permutation(2 * CHARS)[:CHAR_SAMPLED])
                sampled[walk, 0, k] = (at, rng.integers(1, 1 << 63, len(at), np.uint64) | _U(1), _U(rng.integers(1, 1 << 63)))
        self.ready |= {"turn": turn, "sampled": sampled, "tables": {}}

        def add(keys: dict, items: np.ndarray, offsets: np.ndarray) -> None:
            for name, values in keys.items():
                order = np.argsort(values, kind="stable")
                bits = np.zeros(1 << 20, bool)
                bits[values >> _U(44)] = True
                self.ready["tables"][name] = (bits, values[order], items[order], offsets[order])

        item_of = np.repeat(np.arange(len(counts)), counts)
        offset = np.arange(len(w.hashes)) - w.first[:-1][item_of]
        for s in self.ready["sizes"]:
            own = np.flatnonzero(np.array([s in sizes.get(i, ()) for i in range(len(counts))], bool)[item_of] & (offset <= np.maximum(counts[item_of] - s, 0)))
            keys = self.embed(w.hashes, own, w.first[1:][item_of[own]], [s])
            add(keys, item_of[own], offset[own])
        chars, word, first = chars_of(data, w)
        own, item = char_windows(first, 1)
        add(self.embed_chars(chars, own), item, offset[word[own]])
        return self.ready

    def embed(self, hashes: np.ndarray, at: np.ndarray, end: np.ndarray, sizes: list[int]) -> dict:
        """Walks from each word ``at`` up to ``end`` (exclusive; past it a filler is read) and returns the keys by (walk, size, number)."""
        r = self.ready
        padded, filler = np.append(hashes, _U(0)), len(hashes)
        out = {}
        for walk in range(WALKS):
            where = {}
            for s in sizes:
                for k in range(KEYS):
                    steps, factors, salt = r["sampled"][walk, s, k]
                    out[walk, s, k] = np.full(len(at), salt, _U)
                    for j, f in zip(steps.tolist(), factors, strict=True):
                        where.setdefault(j, []).append((out[walk, s, k], f))
            i = at.astype(np.intp)
            x, share, place = np.empty(len(at), _U), np.empty(len(at), _U), np.empty(len(at), np.intp)
            for j in range(max(where, default=-1) + 1):
                np.copyto(place, i)
                np.copyto(place, filler, where=i >= end)
                np.take(padded, place, out=x, mode="clip")
                for key, f in where.get(j, ()):
                    key += np.multiply(x, f, out=share)
                np.multiply(x, r["turn"][walk, j], out=share)
                share >>= _U(63)
                i += share.view(np.int64)
        for key in out.values():
            key ^= key >> _U(32)
            key *= _U(0x94D049BB133111EB)
        return out

    def embed_chars(self, chars: np.ndarray, at: np.ndarray) -> dict:
        """The same for characters, whose hashes and turns are tables of a few values; keys are by (walk, 0, number). No step has to look for a text's end, as chars_of sets texts apart."""
        r, out = self.ready, {}
        padded = chars.astype(np.intp)
        for walk in range(CHAR_WALKS):
            where = {}
            for k in range(self.keys):
                steps, factors, salt = r["sampled"][walk, 0, k]
                out[walk, 0, k] = np.full(len(at), salt, _U)
                for j, f in zip(steps.tolist(), factors, strict=True):
                    where.setdefault(j, []).append((out[walk, 0, k], _CHAR * f))
            i, share, turn = at.astype(np.intp), np.empty(len(at), _U), np.empty(len(at), np.intp)
            x = np.empty(len(at), np.intp)
            for j in range(max(where) + 1):
                np.take(padded, i, out=x, mode="clip")
                for key, table in where.get(j, ()):
                    key += np.take(table, x, out=share, mode="clip")
                i += np.take(((_CHAR * r["turn"][walk, j]) >> _U(63)).astype(np.intp), x, out=turn, mode="clip")
        for key in out.values():
            key ^= key >> _U(32)
            key *= _U(0x94D049BB133111EB)
        return out

    def search(self, texts: pa.Array) -> Iterator[list[tuple[int | None, int, int, int]]]:
        """For each text the items found in it: (item_id, distance, start byte, end byte), each item once, where it is nearest (of ties the first)."""
        r = self.build()
        if not r["sizes"]:
            yield from ([] for _ in range(len(texts)))
            return
        for part in slices(texts, WALK_BYTES):
            yield from self._search(part)

    def candidates(self, raw: list[bytes], w: Words | None = None) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray, np.ndarray]]:
        """For each key, by name: text, item and the word where the item would begin, of all windows of the normalised texts that agree in it."""
        r = self.build()
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return
        w = w or words_of(data, np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))
        text_of = np.repeat(np.arange(len(raw)), np.diff(w.first))
        inner = np.arange(len(w.hashes)) - w.first[:-1][text_of]
        at = np.flatnonzero(inner % r["stride"] == 0)
        chars, word_of, first = chars_of(data, w)
        char_at, _ = char_windows(first, CHAR_STRIDE)
        char_word = word_of[char_at]
        found = self.embed(w.hashes, at, w.first[1:][text_of[at]], r["sizes"]) | self.embed_chars(chars, char_at)
        for name, keys in found.items():
            bits, table, items, offs = r["tables"][name]
            near = np.flatnonzero(np.take(bits, (keys >> _U(44)).view(np.int64), mode="clip"))
            lo = np.searchsorted(table, keys[near])
            n = np.searchsorted(table, keys[near], side="right") - lo
            if not n.any():
                continue
            which = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            word = np.repeat((at if name[1] else char_word)[near], n)
            yield name, text_of[word], items[which], word - offs[which]

    def _search(self, part: pa.Array) -> list[list[tuple[int | None, int, int, int]]]:
        texts = part.to_pylist()
        raw = [normalized(t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        w = words_of(data, np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)) if len(data) else None
        found = [np.stack(x[1:], axis=1) for x in self.candidates(raw, w)]
        out: list[list] = [[] for _ in raw]
        if not found:
            return out
        every = np.concatenate(found)
        low = every[:, 2].min()
        span = int(every[:, 2].max() - low) + 1
        packed = np.unique((every[:, 0] * len(self.items) + every[:, 1]) * span + (every[:, 2] - low))
        pairs, places = packed // span, packed % span + low
        # candidates for one item whose places are next to each other are one stretch of text, checked once
        stays, done, last = [], -1, -1
        for pair, word in zip(pairs.tolist(), places.tolist(), strict=True):
            if pair != last or word > done:
                last, done = pair, word + 1
                stays.append((*divmod(pair, len(self.items)), word))
        best = {}
        for text, item, a, b in self._possible(data, w, stays):
            pattern, pair = self.ready["normal"][item], text * len(self.items) + item
            distance, _ = myers(pattern, data[int(w.start[a]) : int(w.end[b - 1])].tobytes().decode("utf-8", "surrogatepass"), most := int(self.edits * len(pattern)))
            if distance <= most and (pair not in best or distance < best[pair][0]):
                best[pair] = (distance, a, b)
        for pair, (distance, a, b) in best.items():
            text, item = divmod(pair, len(self.items))
            begin, end = _bytes_of(texts[text], a - int(w.first[text]), b - 1 - int(w.first[text]))
            out[text].append((self.items[item][0], distance, begin, end))
        return [sorted(x, key=lambda y: (y[0] is None, y[0] or 0, y[1:])) for x in out]

    def _possible(self, data: np.ndarray, w: Words, candidates: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first word, end) of the candidates' stretches, without those that can't be within the limit.

        The least distances of an item's pieces to a stretch sum up to no more than the item's own, so a sum beyond the limit rules a stretch out.
        """
        codes, char_of = char_codes(data)
        stretches = []
        for text, item, word in candidates:
            first, last = int(w.first[text]), int(w.first[text + 1])
            n = int(self.ready["words"][item])
            slack = max(4, n // 4)  # edits before a place move it by fewer words than they are
            a, b = max(first, word - slack), min(last, word + n + slack + 1)
            if a < b:
                stretches.append((int(char_of[w.start[a]]), int(char_of[w.end[b - 1] - 1]) + 1, text, item, a, b))
        stretches.sort(key=lambda x: x[1] - x[0])  # those of like length go together
        at = 0
        while at < len(stretches):
            some, masks, bits, count = [], [], [], 0
            while at < len(stretches) and (not some or count < PIECES):
                m, last_bits = self._pieces(stretches[at][3])
                masks.append(m)
                bits.append(last_bits)
                some.append(stretches[at])
                count += len(m)
                at += 1
            sizes = np.array([len(m) for m in masks])
            begin, end = (np.repeat(np.array([x[i] for x in some]), sizes) for i in range(2))
            least = least_distances(np.concatenate(masks), np.concatenate(bits), codes, begin, end)
            total = np.add.reduceat(least, np.cumsum(sizes) - sizes)
            for (_, _, text, item, a, b), d in zip(some, total.tolist(), strict=True):
                if d <= int(self.edits * len(self.ready["normal"][item])):
                    yield text, item, a, b

    def _pieces(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        kept = self.ready["pieces"]
        if item not in kept:
            if len(kept) >= KEPT_ITEMS:
                kept.clear()
            kept[item] = piece_masks(char_codes(np.frombuffer(self.ready["normal"][item].encode("utf-8", "surrogatepass"), np.uint8))[0])
        return kept[item]


def _bytes_of(text: str, first: int, last: int) -> tuple[int, int]:
    """The bytes of the original text from its word number ``first`` to the end of number ``last``."""
    begin = end = 0
    for i, m in enumerate(WORDS.finditer(lowered(text))):
        if i == first:
            begin = m.start()
        if i == last:
            end = m.end()
            break
    return len(text[:begin].encode("utf-8", "surrogatepass")), len(text[:end].encode("utf-8", "surrogatepass"))


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", seed: int = 7, edits: float = EDITS, recall: float = RECALL) -> Iterator[Index]:
    """The benchmark in pieces of ITEM_BYTES of text at most (as expected sizes), one for most benchmarks. Null, empty and wordless items are left out, items without an id stay."""
    items = benchmark.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    pieces = -(-(items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]) // ITEM_BYTES)
    for piece in range(pieces):
        own = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(pieces)) == piece) if pieces > 1 else items
        if rows := sorted(((r["i"], r["t"]) for r in own.collect() if WORDS.search(r["t"])), key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            yield Index(rows, seed, edits, recall).fitted()


FOUND = "array<struct<item_id: bigint, distance: int, start: int, end: int>>"


def found_in(text: Column, index: Index) -> Column:
    """The index's items in a text, with their edit distance and the bytes of the stretch they were found in."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    @arrow_udf(FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("item_id", "distance", "start", "end")
        for batch in batches:
            yield pa.array([[dict(zip(names, x, strict=True)) for x in found] for found in index.search(batch)], kind)

    return search(text)


def _all_found(text: Column, benchmark: DataFrame, seed: int, edits: float, recall: float) -> Column:
    columns = [found_in(text, index) for index in indexes(benchmark, seed=seed, edits=edits, recall=recall)]
    return F.concat(*columns) if columns else F.array().cast(FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", id_col: str = "doc_id", seed: int = 7, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """One row per input row: id, ``contaminated``, ``n_items``, ``items`` (ids in order, null last), ``found`` (with distances and stretches).

    A document is contaminated if some part of it is within ``edits`` of an item's characters of the item, both normalised
    (lower case, words with one space between). ``recall``: share of copies edited up to that limit, at random, that candidates are to have; copies edited less are
    found oftener, and what is found is always within the limit. Null and empty texts hold nothing; null ids, of rows and of items, and repeated rows stay; an
    empty benchmark finds nothing; other columns play no part. Candidates come from all windows of whole texts.
    """
    rows = docs.select(F.col(id_col).alias("id"), _all_found(F.col(text), benchmark, seed, edits, recall).alias("found"))
    return rows.select(F.col("id").alias(id_col), (F.size("found") > 0).alias("contaminated"), F.size("found").alias("n_items"), F.array_sort(F.array_distinct(F.col("found.item_id"))).alias("items"), "found")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", seed: int = 7, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """The rows, whole, without any benchmark item."""
    name = free_name(docs, "found")
    return docs.withColumn(name, _all_found(F.col(text), benchmark, seed, edits, recall)).filter(F.size(name) == 0).drop(name)
