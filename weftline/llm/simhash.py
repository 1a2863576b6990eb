"""SimHash near-duplicates: 64-bit fingerprints, a binary-trie self-join within a Hamming budget, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_udf, cut, free_name, lean, ship, slices, stage_table
from weftline.llm.components import connected_components

BITS = 64
#: Rows with one key above which the group is cut into finer ones, or into salted blocks if one word has most of it.
GROUP_ROWS = 50_000
#: Rows that the trie join takes at once, and node pairs it expands at once: they bound a task's memory.
JOIN_ROWS, PAIRS = 50_000, 1 << 16
#: Two nodes with so many pairs of keys at most are compared key by key: below that a trie costs more than it prunes.
LEAF = 256
#: Shingles hashed at once for one long text.
SHINGLES = 16_384
#: Longs of a wide fingerprint. Each half of one is a word of a trie of its own; pairs that any of them finds within
#: WORD_BUDGET bits are candidates if all longs together differ by WIDE_BUDGET bits at most.
#: Set for pairs of similarity 0.8 that differ in one block (about 15 % of the bits): 0.98 of them have such a word, and 80 bits is 3.5 deviations above their mean.
WIDE, WORD_BUDGET, WIDE_BUDGET = 6, 3, 80
#: Bits of all longs within which rows of one word are represented by one of them in the first round of candidates, and how many rows of a word may lead.
#: All rows that are near no leader stand for themselves.
RADIUS, LEADERS = 4, 64
#: Halves of longs whose candidates are tested first, so that those of all others are few.
FIRST_WORDS = 3
#: Bytes of text of a group of candidates above which it is salted into pairs of chunks, whose shingle sets a task holds; rows of smaller groups taken at once.
GROUP_BYTES, SET_ROWS = 8 << 20, 1024
#: Pairs tested before links are looked at again (then twice as many, and so on), and pairs remembered as tested.
TESTED, SEEN = 256, 1 << 20


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes (n x parts) have each bit set, part by part. Bits are added as bytes, in runs that a byte can count."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    runs = len(bits) // 255
    head = bits[: 255 * runs].reshape(runs, 255, bits.shape[1]).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return head + bits[255 * runs :].sum(0, dtype=np.uint8)


def wide_fingerprint(text: str | None, width: int = 3, seed: int = 42, parts: int = WIDE) -> list[int]:
    """``parts`` fingerprints of 64 bits from one hash a shingle: the first is the plain one, the others come of the hash mixed anew."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return [0] * parts
    width = min(width, len(words))
    n = len(words) - width + 1
    votes = np.zeros(parts * BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES):
        part = words[at : at + SHINGLES + width - 1]
        h = np.empty((len(part) - width + 1, parts), "<u8")
        h[:, 0] = [digest(s, seed) for s in map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))]
        for k in range(1, parts):
            x = h[:, k - 1]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x9E3779B97F4A7C15)
            h[:, k] = x ^ (x >> np.uint64(32))
        votes += _votes(h)
    return np.packbits((2 * votes > n).reshape(parts, BITS), axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """A-Z lower-cased, words between ASCII white space, word shingles with repeats (fewer words: the whole sequence); a bit is set if it is in over half the hashes. No words: 0."""
    return wide_fingerprint(text, width, seed, 1)[0]


def wide_column(text: Column, width: int = 3, seed: int = 42) -> Column:
    """``struct<w0, w1, ...>`` of signed longs."""
    names = [f"w{k}" for k in range(WIDE)]

    @arrow_udf("struct<" + ", ".join(f"{n}: bigint" for n in names) + ">")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.array([wide_fingerprint(t, width, seed) for part in slices(batch) for t in part.to_pylist()], np.uint64).reshape(-1, WIDE).view(np.int64)
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(WIDE)], names=names)

    return fingerprints(text)


def fingerprint_column(text: Column, width: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a signed long."""

    @arrow_udf("bigint")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [fingerprint(t, width, seed) for part in slices(batch) for t in part.to_pylist()]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return fingerprints(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _products(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a place in [x, x + nx) and one in [y, y + ny), in pieces of PAIRS at most; of a range with itself each pair of different places once."""
    size = nx * ny
    some = (size > 0) & ((x != y) | (nx > 1))
    small = np.flatnonzero(some & (size <= PAIRS))
    ends = np.cumsum(size[small])
    at = 0
    while at < len(small):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        own = small[at:to]
        of = np.repeat(own, size[own])
        inner = np.arange(len(of)) - np.repeat(ends[at:to] - size[own] - (ends[at - 1] if at else 0), size[own])
        up, rest = np.divmod(inner, ny[of])
        i, j = x[of] + up, y[of] + rest
        if (x[own] == y[own]).any():
            other = (x[of] != y[of]) | (i < j)
            i, j = i[other], j[other]
        yield i, j
        at = to
    for r in np.flatnonzero(some & (size > PAIRS)):
        wide = min(int(ny[r]), PAIRS)
        tall = max(1, PAIRS // wide)
        for a in range(int(x[r]), int(x[r] + nx[r]), tall):
            rows = np.arange(a, min(a + tall, int(x[r] + nx[r])))
            for b in range(int(y[r]), int(y[r] + ny[r]), wide):
                columns = np.arange(b, min(b + wide, int(y[r] + ny[r])))
                i, j = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
                if x[r] == y[r]:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j


def trie_join(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, fixed: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs within ``budget`` differing bits inside each range, in pieces.

    ``keys``: distinct unsigned keys, ascending in each range [start, end); those of a range agree in the top ``fixed`` bits,
    so a range is a subtree of the binary trie. A node is a range of keys with one prefix. Node pairs descend
    together bit by bit, carrying the number of bits that differ; a pair over the budget is dropped with all that is
    below it. Nodes of few keys are leaves, whose keys are compared at once. Pairs wait on a stack in pieces of bounded size.
    """
    ones = {}

    def split(lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - bit)) & np.uint64(1), dtype=np.int64)])
        c = ones[bit]
        return hi - (c[hi] - c[lo])

    stack = [(fixed, np.stack([starts, ends, starts, ends, np.zeros_like(starts)]))]
    while stack:
        bit, f = stack.pop()
        if f.shape[1] > PAIRS:
            half = f.shape[1] // 2
            stack += [(bit, f[:, :half]), (bit, f[:, half:])]
            continue
        nx, ny = f[1] - f[0], f[3] - f[2]
        leaves = nx * ny <= LEAF if bit < BITS else np.ones(f.shape[1], bool)
        if leaves.any():
            for i, j in _products(f[0][leaves], nx[leaves], f[2][leaves], ny[leaves]):
                near = popcount(keys[i] ^ keys[j]) <= budget
                if near.any():
                    yield i[near], j[near]
            f = f[:, ~leaves]
        if not f.shape[1]:
            continue
        same = f[0] == f[2]
        m1, m2, d = split(f[0], f[1], bit), split(f[2], f[3], bit), f[4]
        apart = ~same
        children = np.concatenate(
            [
                np.stack([f[0], m1, f[2], m2, d]), np.stack([m1, f[1], m2, f[3], d]),
                np.stack([f[0], m1, m2, f[3], d + 1]), np.stack([m1, f[1], f[2], m2, d + 1])[:, apart],
            ], axis=1,
        )
        children = children[:, (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= budget)]
        if children.shape[1]:
            stack.append((bit + 1, children))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the smallest item it is linked to by the pairs, directly or not."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(root, hi, lo)
            while not np.array_equal(root, up := root[root]):
                root = up
    return root


def _links_of(budget: int):
    """mapInArrow: whole groups (path, key) of rotated fingerprints, in order, to links ``a, b`` that span the groups' components."""

    def join(path: np.ndarray, key: np.ndarray, fixed: np.ndarray, rot: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for depth in np.unique(fixed):
            own = np.flatnonzero(fixed == depth)
            order = own[np.lexsort((rot.view(np.uint64)[own], key[own], path[own]))]
            p, k, r, f = path[order], key[order], np.ascontiguousarray(rot[order]).view(np.uint64), fp[order]
            first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (k[1:] != k[:-1])]))
            last = np.append(first[1:], len(p))
            big = last - first > 1
            root = forest(len(p), trie_join(r, first[big], last[big], int(depth), budget))
            linked = np.flatnonzero(root != np.arange(len(p)))
            a.append(f[linked])
            b.append(f[root[linked]])
        yield pa.record_batch([pa.array(np.concatenate(x) if x else np.array([], np.int64), pa.int64()) for x in (a, b)], names=["a", "b"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_group(batches, join)

    return links


def _rotated(rot: Column, fixed: int, by: int) -> Column:
    """The lowest 64 - fixed bits turned left by ``by``; the top ones stay."""
    low = BITS - fixed
    if by == 0:
        return rot
    mask = (1 << low) - 1
    signed = lambda x: F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("bigint")
    bottom = rot.bitwiseAND(signed(mask))
    turned = F.shiftleft(bottom, by).bitwiseOR(F.shiftrightunsigned(bottom, low - by)).bitwiseAND(signed(mask))
    return rot.bitwiseAND(signed(~mask & (1 << 64) - 1)).bitwiseOR(turned)


def _routes(rows: DataFrame, keep: list[str], fixed: int, parts: int) -> tuple[DataFrame, list[int]]:
    """Each row once for each of ``parts`` blocks of its free bits, turned so that the block comes first and belongs to the key.

    Two keys that differ in fewer than ``parts`` bits agree in a block, so no link is lost.
    """
    free = BITS - fixed
    widths = [free // parts + (i < free % parts) for i in range(parts)]
    options, by = [], 0
    for i, w in enumerate(widths):
        turned = _rotated(F.col("rot"), fixed, by)
        options.append(F.struct((F.col("path") * parts + i + 1).alias("path"), turned.alias("rot"), F.shiftrightunsigned(turned, BITS - fixed - w).alias("key"), F.lit(fixed + w).alias("fixed")))
        by += w
    return rows.select(*keep, F.explode(F.array(*options)).alias("r")).select(*keep, "r.path", "r.key", "r.fixed", "r.rot"), widths


def _spread(rows: DataFrame, keep: list[str], fixed: int, parts: int) -> DataFrame:
    """Rows (path, rot, and ``keep``) dealt to subtrees of turned tries, each row once for each of ``parts`` blocks of its free bits.

    A subtree with over GROUP_ROWS rows is dealt again by a block of the bits that remain, so a hot block spreads however many
    share it. Where one word alone has half of GROUP_ROWS, or few bits are left, further bits can't cut: such a subtree is salted into
    chunks, and each pair of chunks is a group of its own, so no task gets it whole and every pair of rows still meets.
    """
    ship(rows.sparkSession)
    rows, done = cut(rows), []
    names = ["path", "key", "fixed", "rot", *keep]
    while True:
        routed, widths = _routes(rows, keep, fixed, parts)
        runs = routed.groupBy("path", "key", "rot").count().groupBy("path", "key").agg(F.sum("count").alias("n"), F.max("count").alias("run"))
        hot = cut(runs.filter(F.col("n") > GROUP_ROWS))
        if hot.isEmpty():
            done.append(routed.select(names))
            break
        done.append(routed.join(hot, ["path", "key"], "left_anti").select(names))
        finer = (F.col("run") <= GROUP_ROWS // 2) & F.lit(BITS - fixed - min(widths) > 12)
        done.append(_salted(routed.join(hot.filter(~finer), ["path", "key"]), keep).select(names))
        if hot.filter(finer).isEmpty():
            break
        # a block's width may be one less than another's: the smaller count of agreeing bits holds for all
        rows, fixed = routed.join(hot.filter(finer), ["path", "key"], "left_semi").select("path", "rot", *keep), fixed + min(widths)
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(n, "path", "key").sortWithinPartitions("path", "key")


def _salted(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of subtrees with ``n`` rows, once for each pair of chunks that their own is in; a path of its own tells a pair of chunks."""
    chunks = F.ceil(F.col("n") * 2 / GROUP_ROWS).cast("bigint")
    own = F.pmod(F.xxhash64(*keep), chunks)
    paired = rows.withColumns({"_own": own, "_chunks": chunks}).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1)))
    pair = F.least("_own", "_other") * F.col("_chunks") + F.greatest("_own", "_other") + 1
    return paired.withColumn("path", F.col("path") + F.shiftleft(pair, 24))


def links(fingerprints: DataFrame, column: str, budget: int = 2) -> DataFrame:
    """``a, b``: links between distinct fingerprints of ``budget`` differing bits at most, enough of them to connect all that are linked.

    Fingerprints are dealt to subtrees of budget + 1 turned tries by a block of their bits, so that no link is lost.
    """
    rows = fingerprints.select(F.col(column).alias("fp")).filter("fp is not null").distinct().select("fp", F.lit(0).cast("bigint").alias("path"), F.col("fp").alias("rot"))
    return _spread(rows, ["fp"], 0, budget + 1).mapInArrow(lean(_links_of(budget)), "a bigint, b bigint").distinct()


def spanning(n: int, pieces: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], component: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of weighted pairs, given in pieces, as few as connect what they connect: again and again each component takes its nearest link to a smaller one. Items of one ``component`` are connected already."""
    root, a, b = np.arange(n), [], []
    if component is not None and n:
        _, first, of = np.unique(component, return_index=True, return_inverse=True)
        root = first[of]
    for i, j, weight in pieces:
        while len(i):
            x, y = root[i], root[j]
            apart = x != y
            i, j, weight, x, y = i[apart], j[apart], weight[apart], x[apart], y[apart]
            if not len(i):
                break
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((weight, hi))
            first = order[np.flatnonzero(np.concatenate([[True], hi[order][1:] != hi[order][:-1]]))]
            a.append(i[first])
            b.append(j[first])
            root[hi[first]] = lo[first]
            while not np.array_equal(root, up := root[root]):
                root = up
    none = np.array([], np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _crossed(x: np.ndarray, y: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row of run x and one of run y (begin[r] to begin[r + 1] are the rows of run r), in pieces; of one run each pair of different rows once."""
    return _products(begin[x], begin[x + 1] - begin[x], begin[y], begin[y + 1] - begin[y])


def _near_runs(rot: np.ndarray, group: np.ndarray, fixed: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Runs of rows with one key (where each begins, and the end), and the pairs of runs, each with itself too, whose keys are near. Rows are sorted by group and key."""
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (rot[1:] != rot[:-1])]))
    g = group[first]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    ends = np.append(starts[1:], len(g))
    big = ends - starts > 1

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(len(first)), np.arange(len(first))
        for i, j in trie_join(rot[first], starts[big], ends[big], fixed, WORD_BUDGET):
            yield i, j

    return np.append(first, len(rot)), pairs()


def _wide_pairs(rot: np.ndarray, group: np.ndarray, wide: np.ndarray, fixed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs that connect all candidates among rows sorted by group and key.

    Rows of one key within RADIUS of a leader are joined to it, and leaders of near keys are then compared: by the triangle
    inequality leaders within WIDE_BUDGET + 2 * RADIUS stand for every candidate pair of their rows.
    """
    begin, runs = _near_runs(rot, group, fixed)
    run = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    left, leaders = np.arange(len(rot)), []
    while len(left) and len(leaders) < LEADERS:  # each run's first row leads those near it; the others go on
        heads = left[np.flatnonzero(np.concatenate([[True], run[left][1:] != run[left][:-1]]))]
        leaders.append(heads)
        of = heads[np.searchsorted(run[heads], run[left])]
        rest = left != of
        i, j = of[rest], left[rest]
        d = np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64)
        ok = d <= RADIUS
        yield i[ok], j[ok], d[ok]
        left = j[~ok]
    lead = np.sort(np.concatenate([*leaders, left]))
    begin = np.searchsorted(run[lead], np.arange(len(begin)))
    for x, y in runs:
        for i, j in _crossed(x, y, begin):
            i, j = lead[i], lead[j]
            d = np.bitwise_count(wide[i] ^ wide[j]).sum(1, dtype=np.int64)
            ok = d <= WIDE_BUDGET + 2 * RADIUS
            yield i[ok], j[ok], d[ok]


def _sorted_words(columns: tuple[np.ndarray, ...]) -> Iterator[tuple]:
    """Columns (path, key, fixed, rot, node, wide fingerprint, others) by depth and in order: rot, group, wide, depth, and the order."""
    path, key, fixed, rot, _, *wide = columns
    for depth in np.unique(fixed):
        own = np.flatnonzero(fixed == depth)
        order = own[np.lexsort((wide[0][own], rot[own].view(np.uint64), key[own], path[own]))]
        p, k = path[order], key[order]
        group = np.cumsum(np.concatenate([[0], (p[1:] != p[:-1]) | (k[1:] != k[:-1])]).astype(np.int64))
        yield np.ascontiguousarray(rot[order]).view(np.uint64), group, np.stack([x[order].view(np.uint64) for x in wide[:WIDE]], axis=1), int(depth), order


def _pair_batch(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: whole groups (path, key) of words with their nodes, wide fingerprints and components to pairs of nodes that connect all candidates."""

    def join(*columns) -> Iterator[pa.RecordBatch]:
        for rot, group, wide, depth, order in _sorted_words(columns):
            i, j = spanning(len(order), _wide_pairs(rot, group, wide, depth), columns[5 + WIDE][order])
            names = columns[4][order]
            yield _pair_batch(names[i], names[j])

    yield from _by_group(batches, join)


def _ranks(x: np.ndarray) -> np.ndarray:
    """How many of the same value are before each."""
    order = np.argsort(x, kind="stable")
    v = x[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else order
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
    return out


def _apart(allowed: int):
    """mapInArrow: whole groups of words with their nodes, wide fingerprints and components to candidate pairs of different components: those that a row
    which has not yet ``allowed`` of them on one side has; a pair of nulls tells that there are more."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def join(*columns) -> Iterator[pa.RecordBatch]:
            for rot, group, wide, depth, order in _sorted_words(columns):
                names, c = columns[4][order], columns[5 + WIDE][order]
                begin, runs = _near_runs(rot, group, depth)
                had, more = np.zeros(len(order), np.int64), False
                for x, y in runs:
                    for i, j in _crossed(x, y, begin):
                        other = np.flatnonzero(c[i] != c[j])
                        other = other[np.bitwise_count(wide[i[other]] ^ wide[j[other]]).sum(1, dtype=np.int64) <= WIDE_BUDGET]
                        i, j = i[other], j[other]
                        stays = (had[i] + _ranks(i) < allowed) | (had[j] + _ranks(j) < allowed)
                        more |= not stays.all()
                        i, j = i[stays], j[stays]
                        if len(i):
                            np.add.at(had, i, 1)
                            np.add.at(had, j, 1)
                            yield _pair_batch(names[i], names[j])
                if more:
                    yield pa.record_batch([pa.array([None], pa.int64())] * 2, names=["a", "b"])

        yield from _by_group(batches, join)

    return pairs


def _by_group(batches: Iterator[pa.RecordBatch], join, least: int = 0) -> Iterator[pa.RecordBatch]:
    """Calls ``join`` on columns of whole groups (the first two columns), ``least`` (JOIN_ROWS) rows or more at a time."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        rows += batch.num_rows
        if rows < (least or JOIN_ROWS):
            continue
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        other = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
        whole = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
        if whole:
            yield from join(*(x[:whole] for x in columns))
        held, rows = [[x[whole:] for x in columns]], rows - whole
    if rows:
        yield from join(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _prefixes(sets: list[np.ndarray], group: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets with their hashes numbered by how many sets of a group have them, rare ones first: the numbers set by set in order, and where each set begins;
    and what is in so many sets that it can be the first that two similar ones share: number, set and place, in order."""
    size = np.array([len(x) for x in sets], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    of = np.repeat(np.arange(len(sets)), size)
    held = np.concatenate([np.array([], np.int32), *sets]).astype(np.int64) & 0xFFFFFFFF | group[of] << 32
    _, number, count = np.unique(held, return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    packed = np.sort(of * max(1, len(count)) + rank[number])
    rank, shared = packed - of * max(1, len(count)), np.sort(count) > 1
    place = np.arange(len(rank)) - begin[of]
    # two similar sets share at least this share of either, so no more can come before the first that they share
    own = np.flatnonzero((place <= size[of] - np.ceil(least * size[of] - 1e-9)) & shared[rank])
    own = own[np.argsort(rank[own], kind="stable")]
    return rank, begin, rank[own], of[own], place[own]


class _Links:
    """Links between sets of ``least`` similarity or more, as few as connect what all such links connect. Pairs come with the places of a hash that both have."""

    def __init__(self, rank: np.ndarray, begin: np.ndarray, wide: np.ndarray, least: float):
        self.rank, self.begin, self.size, self.wide, self.least = rank, begin, np.diff(begin), wide, least
        self.root, self.a, self.b = np.arange(len(self.size)), [], []
        self.mark, self.seen = np.zeros(int(rank.max(initial=0)) + 1, bool), np.full(SEEN, -1)

    def meet(self, i: np.ndarray, j: np.ndarray, pi: np.ndarray, pj: np.ndarray) -> None:
        """Tests the pairs that are of different components and, were this the first hash that they share, can be similar enough."""
        need = np.ceil(self.least / (1 + self.least) * (self.size[i] + self.size[j]) - 1e-9)
        may = np.flatnonzero((np.minimum(self.size[i] - pi, self.size[j] - pj) >= need) & (self.root[i] != self.root[j]))
        may = may[np.bitwise_count(self.wide[i[may]] ^ self.wide[j[may]]).sum(1, dtype=np.int64) <= WIDE_BUDGET + 2 * RADIUS]
        pair = np.unique(np.minimum(i[may], j[may]) * len(self.size) + np.maximum(i[may], j[may]))
        slot = (pair * 0x9E3779B1 >> 8) % SEEN
        new = self.seen[slot] != pair
        pair = pair[new]
        self.seen[slot[new]] = pair  # what two pairs share a slot of is only tested once more
        step = TESTED
        while len(pair):
            i, j = np.divmod(pair[:step], len(self.size))
            apart = self.root[i] != self.root[j]
            self._test(i[apart], j[apart])
            pair, step = pair[step:], 2 * step

    def _test(self, i: np.ndarray, j: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[len(i) > 0], i[1:] != i[:-1]])[: len(i)])
        for at, to in zip(first, np.append(first, len(i))[1:], strict=True):
            x = int(i[at])
            own = self.rank[self.begin[x] : self.begin[x + 1]]
            self.mark[own] = True
            for k in range(at, to, TESTED):
                y = j[k : min(to, k + TESTED)]
                n = self.size[y]
                end = np.cumsum(n)
                both = self.mark[self.rank[np.arange(int(end[-1])) + np.repeat(self.begin[y] - end + n, n)]]
                common = np.add.reduceat(both, end - n, dtype=np.int64)
                for other in y[common >= self.least * (len(own) + n - common)].tolist():
                    self.link(x, other)
            self.mark[own] = False

    def link(self, x: int, y: int) -> None:
        lo, hi = sorted((self.root[x], self.root[y]))
        if lo != hi:
            self.root[self.root == hi] = lo
            self.a.append(x)
            self.b.append(y)


def _similar(least: float):
    """mapInArrow: whole groups (of two columns) with side, node, shingles and wide fingerprint to links ``a, b`` that connect all pairs of similar shingle sets in a group
    (if it holds two sides, of different sides) within the candidates' distance. Pairs are met by the hashes that can be the first that similar sets share, rare ones first."""

    def join(root: np.ndarray, part: np.ndarray, side: np.ndarray, node: np.ndarray, sets: np.ndarray, *wide: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(np.concatenate([[0], (root[1:] != root[:-1]) | (part[1:] != part[:-1])]).astype(np.int64))
        low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, -1)
        np.minimum.at(low, group, side)
        np.maximum.at(high, group, side)
        two = (low < high)[group]
        rank, begin, shared, of, place = _prefixes(list(sets), group, least)
        links = _Links(rank, begin, np.stack([x.view(np.uint64) for x in wide], axis=1), least)
        bare = np.flatnonzero(links.size == 0)
        for x, y in zip(bare[:-1], bare[1:], strict=True):  # sets without shingles are alike
            if group[x] == group[y]:
                links.link(int(x), int(y))

        def meet(i: np.ndarray, j: np.ndarray) -> None:
            x, y = of[i], of[j]
            ok = ~two[x] | (side[x] != side[y])
            links.meet(x[ok], y[ok], place[i[ok]], place[j[ok]])

        first = np.flatnonzero(np.concatenate([[True], shared[1:] != shared[:-1]])) if len(shared) else np.array([], np.int64)
        n = np.diff(np.append(first, len(shared)))
        small = n * n <= PAIRS
        for i, j in _products(first[small], n[small], first[small], n[small]):
            meet(i, j)
        for at, k in zip(first[~small].tolist(), n[~small].tolist(), strict=True):
            left = np.arange(at, at + k)
            while len(left) > 1:  # a few rows at a time are met with all that are left, those outside of the largest component first
                component, where, count = np.unique(links.root[of[left]], return_inverse=True, return_counts=True)
                if len(component) == 1:
                    break
                left = left[np.argsort(where == np.argmax(count), kind="stable")]
                tall = max(1, min(PAIRS // len(left), len(left) - int(count.max())))
                for i, j in _products(np.array([0, 0]), np.array([tall, tall]), np.array([0, tall]), np.array([tall, len(left) - tall])):
                    meet(left[i], left[j])
                left = left[tall:]
        yield _pair_batch(node[np.array(links.a, np.int64)], node[np.array(links.b, np.int64)])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _by_group(batches, join, SET_ROWS)

    return similar


def similar_links(nodes: DataFrame, texts: DataFrame, least: float = 0.8, width: int = 5) -> DataFrame:
    """``a, b``: links between nodes whose texts' sets of ``width``-word shingles have a Jaccard similarity of ``least`` or more, as many as connect all such candidates.

    ``nodes``: ``node`` (a number of its own) and w0, w1, ...; ``texts``: ``node, text``. Candidates come from the tries over all words of the
    wide fingerprints, as few pairs as connect all of them (of nodes with one fingerprint the least stands for all). What they connect is a group, and
    the shingle sets of a group meet in one task, where links are found exactly: no pair is written that isn't a link, however many candidates fail.
    Groups of much text are salted into chunks, and each pair of chunks is a task's.
    """
    wide = [f"w{k}" for k in range(WIDE)]
    half = [x for k in range(WIDE) for x in (F.shiftrightunsigned(F.col(f"w{k}"), 32), F.col(f"w{k}").bitwiseAND(0xFFFFFFFF))]
    keep = ["node", *wide, "component"]

    def candidates(rows: DataFrame, chosen: range) -> DataFrame:
        words = rows.select(*keep, F.explode(F.array(*(F.struct(F.lit(k + 1).cast("bigint").alias("path"), half[k].alias("rot")) for k in chosen))).alias("word")).select("word.path", "word.rot", *keep)
        return cut(_spread(words, keep, BITS // 2, WORD_BUDGET + 1).mapInArrow(lean(_candidates), "a bigint, b bigint").distinct())

    heads = cut(nodes.groupBy(*wide).agg(F.min("node").alias("node")).select("node", *wide))
    members = nodes.join(heads.withColumnRenamed("node", "head"), wide).filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    pairs = candidates(heads.withColumn("component", F.col("node")), range(FIRST_WORDS))
    placed = heads.join(connected_components(pairs), "node", "left").select("node", *wide, F.coalesce("root", "node").alias("component"))
    pairs = pairs.unionByName(candidates(placed, range(FIRST_WORDS, len(half)))).unionByName(members)
    grouped = cut(connected_components(pairs).join(nodes, "node"))
    sizes = texts.select("node", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    hot = cut(grouped.select("node", "root").join(sizes, "node").groupBy("root").agg(F.sum("size").alias("n")).filter(F.col("n") > GROUP_BYTES))
    chunks = F.coalesce(F.ceil(F.col("n") * 2 / GROUP_BYTES), F.lit(1)).cast("bigint")
    rows = grouped.join(hot, "root", "left").withColumn("chunks", chunks).withColumn("side", F.pmod(F.xxhash64("node"), "chunks"))
    sets = texts.join(rows, "node").select("root", "chunks", "side", "node", shingle_set(F.col("text"), width).alias("s"), *wide)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
    dealt = sets.withColumn("other", other).select("root", (F.least("side", "other") * F.col("chunks") + F.greatest("side", "other")).alias("part"), "side", "node", "s", *wide)
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "root", "part").sortWithinPartitions("root", "part").mapInArrow(lean(_similar(least)), "a bigint, b bigint")


def shingle_set(text: Column, width: int = 5) -> Column:
    """The different shingles of a text (fewer words: the whole sequence) as 32-bit hashes, in order. Two shingles of two texts of 1,000 words share a hash by chance once in some 4,000 such pairs."""

    @arrow_udf("array<int>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = [pa.array([], pa.list_(pa.int32()))]
            for part in slices(batch):
                sets = [shingle_hashes(t, width) for t in part.to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                done.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets))))
            yield pa.concat_arrays(done)

    return shingles(text)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = min(width, len(words))
    return np.unique(np.array([xxhash.xxh32_intdigest(s) for s in map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))] if n else [], np.uint32).view(np.int32))


def class_ids(rows: DataFrame, fp: str, id_col: str, budget: int = 2) -> DataFrame:
    """``fp, root, component_id``: for each distinct fingerprint its component's smallest fingerprint, and the smallest id of all rows in it. Null ids count last."""
    least = rows.groupBy(F.col(fp).alias("_node")).agg(F.min(id_col).alias("_least"))
    roots = connected_components(links(rows, fp, budget)).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    placed = cut(least.join(roots, "_node", "left").select("_node", "_least", F.coalesce("_root", "_node").alias("_root")))
    of_root = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return placed.join(of_root, "_root").select(F.col("_node").alias("fp"), F.col("_root").alias("root"), "component_id")


def near_duplicates(df: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, budget: int = 2) -> DataFrame:
    """One row per input row: the id, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable).

    Null and empty texts have fingerprint 0 and link like any other; repeated rows and ids stay; null ids stay and
    count last for component_id (null only if no row of the component has an id); other columns, whatever their names, play no part.
    An empty table gives an empty result. Copies are one fingerprint, so a huge group of copies makes no pairs.
    """
    rows = stage_table(df.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text), width).alias("fp")), "fingerprints")
    ids = class_ids(rows, "fp", "id", budget)
    return rows.join(ids, "fp").select(F.col("id").alias(id_col), hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, budget: int = 2) -> DataFrame:
    """The rows of ``df``, whole, that stay: of each component the one with the smallest id, of rows with that id the first by position.

    Rows are told apart by a position of their own in a staged copy, so repeated and null ids are safe.
    """
    fp, row = free_name(df, "fp"), free_name(df, "row")
    staged = stage_table(df.withColumns({fp: fingerprint_column(F.col(text), width), row: F.monotonically_increasing_id()}), "rows")
    slim = staged.select(F.col(fp).alias("fp"), F.col(row).alias("row"), F.col(id_col).alias("id"))
    ids = class_ids(slim, "fp", "id", budget)
    placed = slim.join(ids, "fp")
    kept = placed.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    return staged.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(df.columns)


def keep_one_similar(df: DataFrame, text: str = "text", id_col: str = "doc_id", least: float = 0.8, width: int = 5) -> DataFrame:
    """The rows of ``df``, whole, that stay: one of each group of near copies, the one with the smallest id (of rows with that id the first by position).

    Groups: equal texts (told by 448 bits of hashes), and chains of texts whose ``width``-word shingles have a similarity of ``least`` or more. Links that SimHash
    candidates miss stay unfound (the README has the measured recall); none that are found are below ``least``. Null and wordless texts are one group.
    """
    fp, row, digest = free_name(df, "fp"), free_name(df, "row"), free_name(df, "digest")
    whole = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    staged = stage_table(df.withColumns({fp: wide_column(F.col(text)), row: F.monotonically_increasing_id(), digest: whole}), "rows")
    wide = [f"w{k}" for k in range(WIDE)]
    slim = staged.select(F.col(f"{fp}.*"), F.col(digest).alias("digest"), F.col(row).alias("row"), F.col(id_col).alias("id"))
    # of each text the first row is the node; what its rows have of ids is known before any join
    nodes = cut(slim.groupBy("digest", *wide).agg(F.min("row").alias("node"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")))
    links = similar_links(nodes.select("node", *wide), staged.select(F.col(row).alias("node"), F.col(text).alias("text")), least, width)
    placed = nodes.select("node", "first").join(connected_components(links), "node", "left")
    kept = placed.groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    return staged.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(df.columns)
