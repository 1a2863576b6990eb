import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import common, simhash


def shingles(text, k=5):
    w = text.encode().lower().split()
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def corpus():
    rng = random.Random(8)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("ran", "lo", "mit", "su")]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=150)
        texts.append(base)
        for edits in (0, 1, 1, 2, 3, 9, 20):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "new"
            texts.append(w)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("group_rows", [20, 20_000])
def test_kept_against_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {find(i) for i in range(len(rows))}
    got = {r.doc_id for r in simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert want <= got
    assert len(got - want) <= 0.05 * (len(rows) - len(want))


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "some words here today", 1), (3, "some words here today", 2), (3, "Some words here today", 2), (4, "word " * 9000, 3), (5, "word " * 9000 + "more", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row int")
    kept = simhash.keep_one_similar(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect())[:2] == [1, 3]
    assert simhash.keep_one_similar(df.filter("false")).count() == 0
    assert simhash.keep_one_similar(df.filter("doc_id is null")).count() == 1


def test_spanning_pairs_connect_what_all_pairs_connect():
    rng = np.random.Generator(np.random.PCG64(3))
    for n in (1, 2, 30, 200):
        i, j = rng.integers(0, n, (2, n))
        apart = i != j
        i, j = i[apart], j[apart]
        a, b = simhash.spanning(n, iter([(i[:5], j[:5], i[:5]), (i[5:], j[5:], j[5:])]))
        parts = [simhash.forest(n, iter([(x, y)])) for x, y in ((i, j), (a, b))]
        assert (parts[0] == parts[1]).all()
        assert len(a) == n - len(np.unique(parts[0]))


def test_wide_fingerprints_begin_with_the_plain_one():
    for text in (None, "", "a", "a b c d", "A b  c\td e f g h"):
        assert simhash.wide_fingerprint(text)[0] == simhash.fingerprint(text)


def test_links_behind_failed_candidates_are_found(spark):
    # the fingerprint of row 2 lies between those of rows 1 and 3, whose texts alone are similar
    words = [f"w{i}" for i in range(220)]
    docs = [(1, " ".join(words[:200])), (2, " ".join(words[::-1])), (3, " ".join(words[15:]))]
    a, c = shingles(docs[0][1]), shingles(docs[2][1])
    assert len(a & c) >= 0.8 * len(a | c)
    first = [0x3FF << 32, 0, 0x3FF << 42]
    fields = [f"w{k}" for k in range(simhash.WIDE)]
    nodes = spark.createDataFrame([(i + 1, x, *([0] * (simhash.WIDE - 1))) for i, x in enumerate(first)], ", ".join(f"{f} bigint" for f in ["node", *fields]))
    got = simhash.similar_links(nodes, spark.createDataFrame(docs, "node bigint, text string")).collect()
    assert [(r.a, r.b) for r in got] == [(1, 3)]


def test_one_fingerprint_does_not_make_texts_alike(spark):
    words = [f"w{i}" for i in range(220)]
    docs = [(5, " ".join(words[:200])), (6, " ".join(words[::-1])), (7, " ".join(words[15:])), (8, " ".join(words[::-1][:210]))]
    fields = [f"w{k}" for k in range(simhash.WIDE)]
    nodes = spark.createDataFrame([(i, *([9] * simhash.WIDE)) for i, _ in docs], ", ".join(f"{f} bigint" for f in ["node", *fields]))
    got = simhash.similar_links(nodes, spark.createDataFrame(docs, "node bigint, text string")).collect()
    assert {(r.a, r.b) for r in got} == {(5, 7), (6, 8)}


def test_hot_words_are_cut_and_salted_without_losing_a_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP_ROWS", 40)
    monkeypatch.setattr(simhash, "WIDE_BUDGET", 6)
    rng = np.random.Generator(np.random.PCG64(8))
    n = 400
    wide = np.zeros((n, simhash.WIDE), np.int64)
    wide[:, 1] = rng.integers(0, 1 << 16, n) << 8  # all share every other word, so that those groups can't be cut by bits
    fields = [*(f"w{k}" for k in range(simhash.WIDE)), "component"]
    rows = spark.createDataFrame([(i, *map(int, w), i) for i, w in enumerate(wide)], ", ".join(f"{f} bigint" for f in ["node", *fields]))
    words = rows.selectExpr("node", *fields, "posexplode(array(shiftrightunsigned(w0, 32), w1 & 4294967295)) as (path, rot)").selectExpr("cast(path + 1 as bigint) path", "rot", "node", *fields)
    dealt = simhash._spread(words, ["node", *fields], 32, simhash.WORD_BUDGET + 1)
    assert max(r["count"] for r in dealt.groupBy("path", "key").count().collect()) <= 3 * simhash.GROUP_ROWS
    got = [(r.a, r.b) for r in dealt.mapInArrow(simhash._candidates, "a bigint, b bigint").collect()]
    i, j = np.triu_indices(n, 1)
    near = np.bitwise_count(wide[i, 1] ^ wide[j, 1]) <= 6
    a, b = np.array(got).T
    assert (simhash.forest(n, iter([(i[near], j[near])])) >= simhash.forest(n, iter([(a, b)]))).all()
    root = simhash.forest(n, iter([(a, b)]))
    assert (root[i[near]] == root[j[near]]).all()


def test_crossed_runs_come_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 50)
    begin = np.array([0, 3, 3, 20, 21, 100])
    x, y = np.array([0, 2, 0, 2, 4, 4, 1]), np.array([0, 2, 4, 4, 4, 3, 4])
    got = [p for i, j in simhash._crossed(x, y, begin) for p in zip(i.tolist(), j.tolist(), strict=True) if len(i) <= 50 or 1 / 0]
    want = [(i, j) for a, b in zip(x, y, strict=True) for i in range(begin[a], begin[a + 1]) for j in range(begin[b], begin[b + 1]) if a != b or i < j]
    assert sorted(got) == sorted(want)


def test_all_candidates_are_connected(monkeypatch):
    # of rows with one word, those led by another row still meet the rows of other words
    monkeypatch.setattr(simhash, "WIDE_BUDGET", 10)
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(20):
        n = 60
        wide = np.zeros((n, simhash.WIDE), np.uint64)
        wide[:, 1] = [sum(1 << int(x) for x in rng.permutation(24)[: rng.integers(0, 12)]) for _ in range(n)]
        rot = np.sort(rng.integers(0, 6, n).astype(np.uint64))
        i, j = np.triu_indices(n, 1)
        want = (np.bitwise_count(rot[i] ^ rot[j]) <= simhash.WORD_BUDGET) & (np.bitwise_count(wide[i] ^ wide[j]).sum(1) <= 10)
        root = simhash.forest(n, iter([simhash.spanning(n, simhash._wide_pairs(rot, np.zeros(n, np.int64), wide, 0))]))
        assert (root[i[want]] == root[j[want]]).all()


@pytest.mark.parametrize("kind", ["replaced", "extended", "truncated"])
def test_block_edits_at_the_bound_are_found(spark, kind):
    rng, rows = random.Random(21), []
    vocabulary = [f"t{i}" for i in range(5000)]
    pairs = 100
    for p in range(pairs):
        n = rng.choice((150, 300, 600))
        base = rng.choices(vocabulary, k=n)
        m = {"replaced": (n - 40) // 9, "extended": (n - 4) // 4, "truncated": (n - 4) // 5}[kind]
        at = rng.randrange(5, n - m - 5)
        other = {"replaced": base[:at] + rng.choices(vocabulary, k=m) + base[at + m :], "extended": base + rng.choices(vocabulary, k=m), "truncated": base[: n - m]}[kind]
        a, b = shingles(" ".join(base)), shingles(" ".join(other))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.82
        rows += [(2 * p, " ".join(base)), (2 * p + 1, " ".join(other))]
    kept = simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).count()
    assert kept - pairs <= 0.05 * pairs


def test_a_family_around_the_bound_is_not_tested_pair_by_pair(spark):
    """Edited copies of one text, of which about half the pairs are similar: one component, far fewer tests than pairs."""
    rng, n = random.Random(31), 150
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(3 + i % 4):
            words[rng.randrange(400)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [shingles(t) for _, t in rows]
    similar = [(a, b) for a in range(n) for b in range(a + 1, n) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert 0.2 < len(similar) / (n * (n - 1) / 2) < 0.99
    root = simhash.forest(n, iter([tuple(np.array(similar).T)]))
    kept = simhash.keep_one_similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(root.tolist()))


def test_allowed_candidates_of_each_row():
    n = 60
    wide = [np.zeros(n, np.int64)] * simhash.WIDE
    columns = [np.ones(n, np.int64), np.zeros(n, np.int64), np.full(n, 40), np.zeros(n, np.int64), np.arange(n), *wide, np.arange(n) // 2]
    batch = simhash.pa.record_batch([simhash.pa.array(c) for c in columns], names=list("abcdefghijkl"))
    for allowed in (1, 4, 16, 64):
        got = [(a, b) for r in simhash._apart(allowed)(iter([batch])) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)]
        pairs = [p for p in got if p[0] is not None]
        assert len(set(pairs)) == len(pairs) <= 2 * n * allowed and all(a // 2 != b // 2 for a, b in pairs)
        assert all(sum(i in p for p in pairs) >= min(allowed, n - 2) for i in range(n))
        assert ((None, None) in got) == (len(pairs) < n * (n - 2) // 2)


def test_failed_candidates_are_not_written_pair_by_pair(spark, monkeypatch):
    """Texts of one template, nearly all candidates and hardly any similar: no table of pairs grows with the square of the group, salted or not, and each link is found."""
    rng, n = random.Random(41), 120
    rows = []
    for i in range(n):
        words = [f"b{k}" for k in range(400)]
        at = rng.randrange(350)
        words[at : at + 50] = [f"x{i}y{k}" for k in range(50)]
        rows.append((i, " ".join(words)))
    rows += [(n + i, rows[7 * i][1] + " and some more") for i in range(9)] + [(n + 9, " "), (n + 10, None), (n + 11, "")]
    sets = [shingles(t or "") for _, t in rows]
    similar = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert 12 <= len(similar) < 0.2 * n * n / 2
    root = simhash.forest(len(rows), iter([tuple(np.array(similar).T)]))
    sizes, cut = [], simhash.cut

    def counted(df):
        df = cut(df)
        if {"a", "b"} <= set(df.columns):
            sizes.append(df.count())
        return df

    monkeypatch.setattr(simhash, "cut", counted)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for most in (None, 40_000):
        if most:
            monkeypatch.setattr(simhash, "GROUP_BYTES", most)
        assert sorted(r.doc_id for r in simhash.keep_one_similar(df).collect()) == sorted(set(root.tolist()))
        assert sizes and max(sizes) <= 4 * len(rows)


def test_similar_sets_of_groups_meet_whatever_their_sides(monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 200)  # hashes of few sets are in many
    monkeypatch.setattr(simhash, "TESTED", 3)
    rng = np.random.Generator(np.random.PCG64(12))
    n, groups = 240, 3
    root, side = np.sort(rng.integers(0, groups, n)), rng.integers(0, 2, n)
    sets = [np.unique(rng.permutation(60)[: rng.integers(40, 60)] - 30).astype(np.int32) for _ in range(n)]
    sets[5] = sets[6] = np.array([], np.int32)
    for sides in (side, np.zeros(n, np.int64)):
        columns = [root, np.zeros(n, np.int64), sides, np.arange(n)]
        batch = simhash.pa.record_batch([*(simhash.pa.array(c) for c in columns), simhash.pa.array(sets, simhash.pa.list_(simhash.pa.int32())), *[simhash.pa.array(np.zeros(n, np.int64))] * simhash.WIDE], names=list("abcdefghijk"))
        got = [(a, b) for r in simhash._similar(0.8)(iter([batch])) for a, b in zip(r.column(0).to_pylist(), r.column(1).to_pylist(), strict=True)]
        alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))
        want = [(a, b) for a in range(n) for b in range(a + 1, n) if root[a] == root[b] and (sides is not side or side[a] != side[b] or not len(sets[b])) and alike(a, b)]
        assert len(want) > 300 and all(root[a] == root[b] and alike(a, b) for a, b in got)
        parts = [simhash.forest(n, iter([tuple(np.array(x).T)])) for x in (want, got)]
        assert (parts[0] == parts[1]).all() and len(got) == n - len(set(parts[0].tolist()))


def test_memory_of_shingle_sets_is_bounded():
    """Groups meet some at a time: 4,000 texts of 400 words in 400 groups; what a task holds doesn't grow with its rows."""
    rng = np.random.default_rng(4)
    sets, n = [], 4000
    for _ in range(n // 10):
        base = rng.integers(-(1 << 31), 1 << 31, 420)
        sets += [np.unique(np.append(base, rng.integers(-(1 << 31), 1 << 31, 20))).astype(np.int32) for _ in range(10)]
    of = np.arange(n) // 10
    names = ["root", "part", "side", "node", "s", *(f"w{k}" for k in range(simhash.WIDE))]
    columns = [of, np.zeros(n, int), np.zeros(n, int), np.arange(n), None, *[np.zeros(n, int)] * simhash.WIDE]
    every = pa.record_batch([pa.array(sets, pa.list_(pa.int32())) if c is None else pa.array(c) for c in columns], names=names)
    tracemalloc.start()
    links = sum(b.num_rows for b in simhash._similar(0.8)(every.slice(at, 100) for at in range(0, n, 100)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == n - n // 10
    assert peak < 80 << 20, peak


def test_what_a_worker_has_freed_goes_back():
    """A worker stays from stage to stage; small blocks that a stage has freed, below one that stays, don't count in the next."""
    held = []

    def stage(batches):
        blocks = [bytes(2000) for _ in range(100_000)]
        held.append(bytes(2000))
        yield from batches
        del blocks

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    before = resident()
    assert list(common.lean(stage)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 100 << 20
