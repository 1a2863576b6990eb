import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import lm


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6, None), (10**6, ""), (None, "the the zzqq")], "doc_id bigint, text string")).cache()


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.mark.parametrize("common", [0, 50, 1 << 17])
def test_base_score_by_hand(spark, docs, monkeypatch, common):
    monkeypatch.setattr(lm, "COMMON", common)
    rows = docs.collect()
    counts = Counter(t for r in rows if not held(r.doc_id) for t in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r.doc_id or -1, held(r.doc_id), len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6)) for r in rows for t in [tokens(r.text)])
    got = sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(docs, lm.train(docs)).collect())
    assert got == want


def test_scores_beat_uniform_and_are_repeatable(docs):
    model = lm.train(docs)
    rows = lm.score(docs, model).filter("held_out and n_tokens > 50").collect()
    assert rows and max(r.bits_per_byte for r in rows) < 6 and sum(r.bits_per_byte for r in rows) / len(rows) < 4
    again = {(r.doc_id, r.n_tokens): r.score for r in lm.score(docs.repartition(5), model).collect()}
    assert all(abs(again[r.doc_id, r.n_tokens] - r.score) < 1e-6 * abs(r.score) for r in rows)
    empty = lm.score(docs.filter("false"), model)
    assert empty.count() == 0
    untaught = lm.score(docs.limit(3), lm.train(docs.filter("false"))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 and abs(r.base_score) < 1e-9 for r in untaught)


def small_mixer():
    rng = np.random.Generator(np.random.PCG64(1))
    trees = lm.Trees(rng.integers(0, 50, (256, lm.SYMBOLS)) * (rng.random((256, lm.SYMBOLS)) < 0.1))
    tables = [rng.integers(-900, 900, 1 << 16).astype(np.int16) for _ in lm.ORDERS]
    return lm.Mixer(trees, tables, rng.random((lm.GATES * lm.CLASSES, lm.INPUTS + 1)))


def test_probabilities_of_all_next_symbols_sum_to_one():
    """The decisions of every symbol after a byte make one binary tree, so the probabilities of all of them sum to one."""
    trees = small_mixer().trees
    for before in (0, 65, 200):
        total = sum(0.5 ** int(trees.length[before, s]) for s in range(lm.SYMBOLS))
        assert abs(total - 1) < 1e-12
        codes = {tuple(zip(trees.nodes[a : a + n].tolist(), trees.bits[a : a + n].tolist(), strict=True)) for a, n in zip(trees.start[before].tolist(), trees.length[before].tolist(), strict=True)}
        assert len(codes) == lm.SYMBOLS


def test_mixer_against_one_decision_at_a_time(monkeypatch):
    monkeypatch.setattr(lm, "FIRST_BLOCK", 8)
    mixer = small_mixer()
    texts = ["hello world, héllo", "", "ab" * 60, "x"]
    data, offsets = lm.joined(texts)
    got = mixer.log10(data, offsets)
    d = lm.decisions(lm.Symbols.build(data, offsets), mixer.trees, 16)
    x = np.array(mixer.inputs(d), float) / lm.SCALE
    for t in range(len(texts)):
        change, spread, total = np.zeros(len(x)), np.zeros(len(x)), 0.0
        for r in np.flatnonzero(d.text == t):
            step = np.zeros(len(x))
            for i in range(d.bounds[r], d.bounds[r + 1]):
                gate = mixer.trees.gates[d.code[i]]
                z = mixer.weights[gate, :-1] @ x[:, i] + mixer.weights[gate, -1] + change @ x[:, i]
                p = 1 / (1 + math.exp(-z))
                total += math.log10(p if d.bits[i] else 1 - p)
                step += (d.bits[i] - p) * x[:, i]
                spread += p * (1 - p) * x[:, i] ** 2
            change += step / (spread + lm.PRIOR)
        assert abs(total - got[t]) < 1e-3 * max(1, abs(total))
    assert [int((d.text == t).sum()) for t in range(len(texts))] == [2, 1, 5, 1]
    # a text's score doesn't depend on its neighbours
    alone = [mixer.log10(*lm.joined([t]))[0] for t in texts]
    assert np.allclose(alone, got, rtol=1e-5)


def by_slot(texts, trees, bits):
    d = lm.decisions(lm.Symbols.build(*lm.joined(texts)), trees, bits)
    return [np.bincount((slots.astype(np.int64) << 1) | d.bits, minlength=2 << bits) for slots in d.slots]


def test_tables_count_every_decision(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).limit(60).repartition(5).cache()
    trees = small_mixer().trees
    got = lm.context_counts(rows, trees, 17)
    for counts, want in zip(got, by_slot([r.text for r in rows.collect()], trees, 17), strict=True):
        assert (counts == want).all()


def test_the_model_learns_from_every_training_row(docs):
    """Its tables are those of the counts over the whole training fold, the rows that fit the weights included."""
    mixer = lm.train(docs).mixer
    texts = [r.text or "" for r in docs.collect() if not held(r.doc_id)]
    for table, want in zip(mixer.tables, by_slot(texts, mixer.trees, mixer.bits), strict=True):
        assert (table == lm.logits(want)).all()


def test_tables_grow_with_the_input():
    assert [lm.slot_bits(n) for n in (0, 10**6, 10**8, 10**9, 10**13)] == [16, 16, 19, 22, 22]
    assert lm.slot_bits(4 * 10**8) == lm.slot_bits(10**8) + 2


def test_long_texts_clashing_columns_and_repeats(spark, docs):
    long = " ".join(f"word{i % 977} and" for i in range(60_000))
    rows = spark.createDataFrame([(1, long, "x", 5), (1, long, "x", 5), (2, "short", None, 6), (None, None, "y", 7)], "doc_id bigint, text string, rare string, key int")
    model = lm.train(docs)
    got = lm.score(rows, model).collect()
    assert len(got) == 4 and sorted(r.n_tokens for r in got) == [1, 2, 120_001, 120_001]
    alone = model.mixer.log10(*lm.joined([long]))[0]
    assert all(abs(r.score - alone) < 1e-4 * abs(alone) for r in got if r.n_tokens > 9)


def test_gate_weights_are_learned_from_every_training_text(spark):
    """One Newton step by all texts, each decision predicted by tables without itself; held against a plain sum, text by text."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "Ünïcode", "x1"], rng.integers(0, 40))) for _ in range(30)]
    pairs = np.zeros((256, lm.SYMBOLS), np.int64)
    s = lm.Symbols.build(*lm.joined(texts))
    np.add.at(pairs, (s.codes[s.at - 1].astype(int), s.codes[s.at].astype(int)), 1)
    trees, bits = lm.Trees(pairs), lm.SLOT_BITS[0]
    counts = np.zeros((len(lm.ORDERS), 2 << bits), np.uint32)
    lm.tallies(texts, trees, bits, counts)
    start = np.tile(lm.START, (lm.GATES * lm.CLASSES, 1))
    k = lm.INPUTS + 1
    hessian, gradient = np.zeros((k, k, len(start))), np.zeros((k, len(start)))
    for t in texts:
        d = lm.decisions(lm.Symbols.build(*lm.joined([t])), trees, bits)
        x = [trees.logits[d.code] / lm.SCALE]
        for c, i in zip(counts.astype(float).reshape(len(lm.ORDERS), -1, 2), d.slots, strict=True):
            x.append(np.clip(np.log((c[i, 1] - d.bits + 0.3) / (c[i, 0] - (1 - d.bits) + 0.3)), -15, 15))
        x.append(np.ones(len(d.code)))
        g = trees.gates[d.code]
        p = 1 / (1 + np.exp(-sum(start[g, i] * v for i, v in enumerate(x))))
        for i in range(k):
            np.add.at(gradient[i], g, (d.bits - p) * x[i])
            for j in range(k):
                np.add.at(hessian[i, j], g, p * (1 - p) * x[i] * x[j])
    want = start + lm.newton_step(hessian, gradient, start)
    got = lm.refitted(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), trees, counts, start)
    assert np.abs(want - start).max() > 0.01 and np.allclose(got, want, atol=5e-3)  # tables have 256ths
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    few, all_but_none = (lm.train(rows, fit_rows=n).mixer.weights for n in (1, 0))
    assert np.abs(all_but_none - start).max() > 0.01 and np.abs(few - start).max() > 0.01  # rows that are in no sample teach


def test_the_driver_holds_one_set_of_counts():
    """Tables are made some slots at a time, and the sample is left out without counts of its own: at most half of the counts comes on top, tables included."""
    trees = small_mixer().trees
    texts = [f"hello world {i} and others" for i in range(80)]
    counts = np.full((len(lm.ORDERS), 2 << 20), 7, np.uint32)
    lm.tallies(texts, trees, 20, counts)
    before = counts.copy()
    own = np.zeros_like(counts)
    lm.tallies(texts, trees, 20, own)
    want = [lm.logits(c - o) for c, o in zip(counts, own, strict=True)]
    tracemalloc.start()
    got = lm.tables_without(texts, trees, 20, counts)
    made = [lm.without_itself(c) for c in counts]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all((g == w).all() for g, w in zip(got, want, strict=True)) and (counts == before).all()
    assert peak < sum(x.nbytes for x in (*got, *made)) + counts.nbytes // 2, peak
