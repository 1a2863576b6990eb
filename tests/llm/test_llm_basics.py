import random
import zlib

import pyarrow as pa
import pytest
from oracle import compare
from pyspark.sql import functions as F

from weftline.llm import components, decontaminate, langid, licenses, queries, sentencepieces, sharding, simhash, toxicity, urls

#: Null and empty texts, repeats, a column whose name clashes with a result's.
ODD = [(1, None, "x"), (2, "", "y"), (None, "some words here today", "z"), (3, "some words here today", None), (3, "some words here today", None), (4, "123 !!", "s"), (5, "word " * 40_000, "l")]
SCHEMA = "doc_id bigint, text string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    compare(spark, sf, queries.QUERIES[name], queries.ORACLES[name])


# 1
def test_tokenizer_parity_and_round_trip(spark, sf):
    data = sentencepieces.read_model(sentencepieces.DEFAULT_MODEL)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a  b ", "x", "\t\n", "a\u0000b", "日本語 \U00010000", "<s> </s> <unk> <0x41>", "é" * 300, "a" * 5000, "  " * 40, "1234567890"]
    assert sentencepieces.parity(data, texts) == []


def test_unigram_model_is_rebuilt(tmp_path):
    """A unigram model written by hand as protobuf gives the library's ids."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    import struct

    def sub(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    def piece(text, score, kind):
        return sub(1, sub(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + varint(3 << 3) + varint(kind))

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *((f"<0x{b:02X}>", -20, 6) for b in range(256)), ("▁", -3, 1), ("▁the", -2, 1), ("a", -4, 1), ("b", -4, 1), ("ab", -5, 1), ("t", -6, 1), ("h", -6, 1), ("e", -6, 1), ("he", -7, 1)]
    trainer = varint(3 << 3) + varint(1) + varint(35 << 3) + varint(1)
    normalizer = sub(1, b"identity") + varint(3 << 3) + varint(1) + varint(4 << 3) + varint(1) + varint(5 << 3) + varint(1)
    data = b"".join(piece(*p) for p in pieces) + sub(2, trainer) + sub(3, normalizer)
    assert sentencepieces.parse(data).kind == sentencepieces.UNIGRAM
    assert sentencepieces.parity(data, ["the ab", "abab  hé the", "b", " a "]) == []


def test_encoding_of_odd_rows(odd, empty):
    rows = sentencepieces.encode(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[1].token_ids is None and by[1].n_tokens is None and by[2].token_ids == [] and by[2].n_tokens == 0
    assert all(r.round_trip for r in rows if r.doc_id != 1)
    back = {(r.doc_id, r.text) for r in sentencepieces.decode(sentencepieces.encode(odd)).collect()}
    assert back == {(i, t) for i, t, _ in ODD}
    assert sentencepieces.encode(empty).count() == 0


# 2
def near(a, b, most):
    """Optimal string alignment distance within a bound."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and a[i - 1] != b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1] <= most


def test_automaton_against_edit_distances():
    rng = random.Random(3)
    terms = ["scum", "idiot", "stupid", "pathetic", "unbearableness", "abab"]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(4000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(4)
            if kind == 0:
                w.insert(at, rng.choice("abitu"))
            elif kind == 1 and at < len(w) > 1:
                del w[at]
            elif kind == 2 and at < len(w):
                w[at] = rng.choice("abitu")
            elif at + 1 < len(w):
                w[at], w[at + 1] = w[at + 1], w[at]
        word = "".join(w)
        got = lexicon.match(word)
        assert (got is not None) == any(near(word, t, lexicon.allowed(t)) for t in terms), word
        if got:
            assert near(word, *got)


def toxic_fixture(spark, copies=1):
    rng = random.Random(5)
    filler = [f"{a}{b}" for a in ("ta", "lo", "mi", "ne", "su", "ra") for b in ("ka", "pe", "do", "vi", "lu", "no")]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(filler, k=60)
        bad = i % 6 == 0
        if bad:
            for t in rng.sample(["grumblehead", "dunderpate", "nincompoop"], 2):
                words.insert(rng.randrange(60), t)
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity_learns_spells_and_quotes(spark, odd, empty):
    docs, labels = toxic_fixture(spark)
    model = toxicity.train(docs, labels)
    assert set(model.weights) == {"grumblehead", "dunderpate", "nincompoop"}
    got = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert all(r.predicted == r.toxic for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    plain = "taka lope dunderpate mido neno suvi grumblehead ralu tado"
    misspelled = plain.replace("dunderpate", "dundrepate").replace("grumblehead", "grumblhead")
    quoted = 'taka lope he said "dunderpate" mido neno suvi ralu he said "grumblehead" tado'
    assert model.score(plain) >= 0.3 > model.score("taka lope mido")
    assert [h.edits for h in model.hits(misspelled)] == [1, 1]
    assert model.score(misspelled) > model.score("taka lope mido")
    assert all(h.quoted for h in model.hits(quoted)) and model.score(quoted) < model.score(plain)
    assert model.score("dundrepate " * 500) < 0.3
    assert [("\u0130 dunderpate"[h.start : h.end]) for h in model.hits("\u0130 dunderpate")] == ["dunderpate"]
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(docs, labels.filter("false"))
    assert not none.weights and toxicity.score(docs, none).filter("predicted = 1").isEmpty()
    assert toxicity.keep_clean(odd, model).columns == odd.columns and toxicity.keep_clean(odd, model).count() == len(ODD)
    assert toxicity.spans(docs, model).filter("end - start < 5").isEmpty()


def test_several_misspelled_terms_are_toxic(spark):
    model = toxicity.train(*toxic_fixture(spark))
    text = "taka lope dundrepate mido neno grumblhead suvi ralu nincompop tado"
    assert {(h.term, h.edits) for h in model.hits(text)} == {("dunderpate", 1), ("grumblehead", 1), ("nincompoop", 1)}
    assert model.score(text) >= model.threshold
    assert model.score(text) > model.score(text.replace("grumblhead", "mido")) > model.score("dundrepate " * 500)


def features_by_hand(model, text):
    """Hits by edit distances to all terms, windows by lists of words, features by their definitions."""
    import math
    import re

    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
    spans = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\w+", low)]
    hits = []
    for i, (a, b, w) in enumerate(spans):
        found = []
        for t in model.weights:
            most = 2 if len(t) >= toxicity.TWO_EDITS else int(len(t) >= toxicity.ONE_EDIT)
            found += [(k, t) for k in range(most + 1) if near(w, t, k)][:1]
        if found:
            window = range(max(0, i - 6), min(len(spans), i + 7))
            said = any(spans[k][2] in toxicity.REPORTING for k in window)
            left, right = low[spans[window[0]][0] : a], low[b : spans[window[-1]][1] + 1]
            marks = bool(set(left) & set(toxicity.OPENING)) and bool(set(right) & set(toxicity.CLOSING))
            edits, term = min(found)
            hits.append((a, w, term, edits, said or marks))
    once, spelled = [], set()
    for h in hits:
        if not h[3] or h[1] not in spelled:
            once.append(h)
            spelled |= {h[1]} if h[3] else set()
    if not once:
        return [], (0.0,) * 6
    weight = lambda h: model.misspelled.get(h[2], 0.0) if h[3] else model.weights[h[2]]
    mass = [sum(weight(h) for h in once if k(h)) for k in (lambda h: not h[3] and not h[4], lambda h: h[3] and not h[4], lambda h: h[4])]
    plain = [(h[0], h[2], 1.0 if not h[3] else 0.5) for h in once if not h[4] and (not h[3] or weight(h) > 0)]
    terms = sum(max(x for _, u, x in plain if u == t) for t in {t for _, t, _ in plain})
    crowd = max((sum(x for b, _, x in plain if 0 <= a - b <= 72) for a, _, _ in plain), default=0.0)
    density = 1000 * sum(x for _, _, x in plain) / (1 + len(text) / 6)
    return hits, (*map(math.log1p, mass), math.log1p(terms), math.log1p(max(0.0, crowd - 1)), math.log1p(density))


def test_features_by_hand(spark):
    import math

    model = toxicity.train(*toxic_fixture(spark))
    rng = random.Random(12)
    words = ["grumblehead", "dunderpate", "nincompoop", "grumblhead", "dundrepate", "nincompooop", "said", "taka", "lope", "mido", '"taka', 'neno"', "«suvi", "ralu»", "İx", "dunder", "Nincompoop"]
    for _ in range(150):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 50)))
        hits, want = features_by_hand(model, text)
        assert [(h.start, h.term, h.edits, h.quoted) for h in model.hits(text)] == [(a, t, e, q) for a, _, t, e, q in hits]
        assert model.features(text) == pytest.approx(want)
        z = model.bias + sum(c * x for c, x in zip(model.coefficients, want, strict=True))
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)))


def test_the_sample_is_bounded_and_judged_by_parts(spark):
    docs, labels = toxic_fixture(spark)
    many = docs.unionByName(docs.filter("doc_id = 6").crossJoin(spark.range(3000)).select("doc_id", F.concat("text", F.lit(" "), "id").alias("text")))
    model = toxicity.train(many, labels, max_rows=500)
    assert set(model.weights) <= {"grumblehead", "dunderpate", "nincompoop"}
    got = toxicity.cross_validated(docs, labels)
    assert sum(got.values()) == labels.filter("crc32(cast(doc_id as string)) % 4 <> 2").count()
    assert got["fp"] == got["fn"] == 0


# 3
def test_license_scan(spark, odd, empty):
    mit = dict(licenses.KNOWN)["MIT"]
    full = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("Permission"))
    assert mit
    rows = spark.createDataFrame([(1, "Copyright (c) 2024 Someone\n\n" + full.upper().replace(",", " ,") + "\r\n"), (2, full.replace("sublicense", "sublicence")), (3, full + " more"), (4, "x\nreleased under the mit licence\ny")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    assert got[1].license == got[2].license == "MIT" and got[3].license is None and got[4].license is None
    assert got[4].notices == "MIT" and got[4].n_notices == 1
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(empty).count() == 0


def wrapped(text, width=72):
    import textwrap

    return "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in text.split("\n"))


def test_whole_licences_in_any_layout(spark):
    whole = [(n, t) for n, t in licenses.KNOWN if "\n" in t]
    rows = [(i, f"{head}{wrapped(t, w)}\n") for i, (n, t) in enumerate(whole) for head in ("", "Copyright (c) 2019-2024, Some Body <x@y.z>\nAll rights reserved.\n\n", "© Jane Doe\n") for w in (40, 72, 100)]
    assert {n for n, _ in whole} >= {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "Zlib", "BSL-1.0"}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and all(r.license == whole[r.doc_id][0] for r in got)


def test_clauses_about_copyright_stay(spark):
    kept = ["copyright notice and this permission notice appear in all copies.", "(c) You must retain notices", "COPYRIGHT HOLDERS BE LIABLE", "copyright law, the author", "all rights reserved by them stay"]
    gone = ["Copyright (c) 2020 A", " * Copyright 1999-2001, B", "(C) 2001 C", "© D", "Copyright by E", "Copyright <year> <holder>", "Copyright F, 2011", "All rights reserved.", "# Copyright © G"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(kept + gone)], "i int, t string").select("i", licenses.canonical(F.col("t")).alias("c"))
    assert [bool(r.c) for r in rows.orderBy("i").collect()] == [True] * len(kept) + [False] * len(gone)
    assert [bool(licenses.canonical_text(t)) for t in kept] == [True] * len(kept)


def test_long_licences_by_digest(spark):
    import os

    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    rows = [(v, open(f"/usr/share/common-licenses/{k}").read()) for k, v in names.items() if os.path.exists(f"/usr/share/common-licenses/{k}")]
    if not rows:
        pytest.skip("no licence files here")
    got = licenses.scan(spark.createDataFrame([(n, t.upper() + "\n\n") for n, t in rows], "doc_id string, text string")).collect()
    assert all(r.license == r.doc_id for r in got)


def test_a_callers_own_table(spark, odd):
    full = next(t for n, t in licenses.KNOWN if n == "MIT" and t.startswith("Permission"))
    rows = spark.createDataFrame([(1, full), (2, "x\nfree for all, always\nfree for all; always!\ny")], "doc_id bigint, text string")
    assert {r.doc_id: (r.license, r.notices) for r in licenses.scan(rows, known=(("MIT", full),)).collect()} == {1: ("MIT", ""), 2: (None, "")}
    got = {r.doc_id: (r.license, r.notices, r.n_notices) for r in licenses.scan(rows, known=(("Own", "Free for all. Always."),)).collect()}
    assert got == {1: (None, "", 0), 2: (None, "Own,Own", 2)}
    assert licenses.scan(rows, known=(), more={}).filter("license is not null or n_notices > 0").isEmpty()
    assert licenses.scan(odd, known=(("Nothing", "!!"),)).filter("license is not null").isEmpty()


# 4
@pytest.mark.parametrize(
    "url, want",
    [
        (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("HTTP://A.Example.ORG/es/1?q#f", ("a.example.org", "/es/1", "example.org/es/", "block")),
        ("http://example.org/ES/1", ("example.org", "/ES/1", "org/", "allow")), ("http://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")), ("http://x.com", ("x.com", "", None, "allow")),
        ("http://x.com?casino", ("x.com", "", None, "block")), ("http://x.com/fr/casino", ("x.com", "/fr/casino", "com/fr/", "allow")), ("http://x-bets.net/free", ("x-bets.net", "/free", None, "block")),
        ("http://casinos.net/free", ("casinos.net", "/free", None, "allow")), ("http://a.net/b://c", ("a.net", "/b://c", None, "allow")), ("http://com/de/", ("com", "/de/", "com/de/", "block")),
    ],
)
def test_url_verdicts(spark, url, want):
    r = urls.judge_urls(spark.createDataFrame([(1, url)], "page_id bigint, url string")).first()
    assert (r.host, r.path, r.rule, r.verdict) == want


def test_urls_of_odd_rows(spark):
    long = "http://a.net/" + "x/" * 200_000 + "casino"
    rows = spark.createDataFrame([(1, long, "v"), (None, "http://com/de/", "w"), (2, "", "x"), (2, "", "x"), (2, None, "y")], "page_id bigint, url string, verdict string")
    got = urls.judge_urls(rows).collect()
    assert len(got) == 5 and sorted(r.verdict for r in got) == ["allow"] * 3 + ["block"] * 2
    assert urls.judge_urls(rows.filter("false")).count() == 0


# 5
def test_shards_by_hand(spark):
    """The law and the permutation, computed a second way."""
    import hashlib
    from collections import defaultdict

    ids = list(range(400)) + [None, None]
    rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id bigint, text string")
    got = sharding.shuffle_into_shards(rows, 5, seed=3, bucket_bytes=300).collect()

    def digest(shard, i):
        return hashlib.md5(f"weft:{shard}:{'null' if i is None else i}".encode()).hexdigest(), shard

    assert all(r.shard == max(range(5), key=lambda s: digest(s, r.doc_id)) for r in got)
    assert all(r.grown_shard == max(range(6), key=lambda s: digest(s, r.doc_id)) for r in got)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += len(r.text) + 16
    buckets = -(-max(sizes.values()) // 300)
    mixes = {(r.doc_id, r.text): r.m for r in rows.select("doc_id", "text", F.xxhash64(F.lit(3), "doc_id", "text").alias("m")).collect()}
    for shard in range(5):
        base = 0
        for bucket in range(buckets):
            own = sorted((r for r in got if r.shard == shard and mixes[r.doc_id, r.text] % buckets == bucket), key=lambda r: mixes[r.doc_id, r.text])
            assert all(r.bucket == bucket for r in own)
            order = sharding.fisher_yates(len(own), 3, shard, bucket)
            assert [own[i].slot - base for i in order] == list(range(len(own)))
            base += len(own)


def test_rows_alike_in_every_column_spread(spark):
    rows = spark.range(4000, numPartitions=4).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("same text").alias("text"))
    got = sharding.shuffle_into_shards(rows, 4, bucket_bytes=5000)
    sizes = [r["count"] for r in got.groupBy("shard", "bucket").count().collect()]
    assert sum(sizes) == 4000 and len(sizes) >= 15 and max(sizes) < 600
    assert sorted(r.slot for r in got.collect()) == list(range(4000))


def test_nth_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(2)
    values = [rng.randrange(6) for _ in range(500)] + [None] * 0
    for some in (values, values[::-1]):
        got = spark.createDataFrame([(v,) for v in some], "v bigint").coalesce(1).select("v", sharding.nth_of(F.col("v")).alias("n")).collect()
        assert sorted((r.v, r.n) for r in got) == sorted((v, k) for v in set(values) for k in range(values.count(v)))


def test_shards_are_written_in_folders(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    sharding.write_shards(rows, str(tmp_path / "out"), 3, bucket_bytes=2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    want = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(rows, 3, bucket_bytes=2000).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in back.collect()} == want


def test_sharding(spark, odd, empty):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 50).cast("int")).alias("text"), F.lit(1).alias("Slot"))
    out = sharding.shuffle_into_shards(rows, 7, bucket_bytes=4000)
    got = out.collect()
    assert out.columns[:3] == ["doc_id", "text", "Slot"] and "_slot" in out.columns
    assert sorted(r.doc_id for r in got) == list(range(3000))
    for s in range(7):
        own = sorted(r["_slot"] for r in got if r.shard == s)
        assert own == list(range(len(own))) and len(own) > 300
    assert len({(r.shard, r.bucket) for r in got}) > 20
    more = {r.doc_id: r.shard for r in sharding.shuffle_into_shards(rows, 8).select("doc_id", "shard").collect()}
    assert all(r.grown_shard == more[r.doc_id] and r.grown_shard in (r.shard, 7) for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.shuffle_into_shards(rows.repartition(3), 7, bucket_bytes=4000).collect()))
    assert all(r["size"] == 16 + 2 * (r.doc_id % 50) for r in got)
    assert sharding.shuffle_into_shards(odd, 3).count() == len(ODD) and sharding.shuffle_into_shards(empty, 3).count() == 0
    order = sharding.fisher_yates(1000, 1, 2, 3)
    assert sorted(order) == list(range(1000)) and sum(a == b for a, b in enumerate(order)) < 20


# 8
def brute_components(fps, ids, budget=2):
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= budget:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for f, i in zip(fps, ids, strict=True):
        least[find(f)] = min(least.get(find(f), i), i)
    return [least[find(f)] for f in fps]


def fingerprint_by_hand(text):
    import re

    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    fps = [fingerprint_by_hand(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip(fps, brute_components(fps, [r.doc_id for r in rows]), strict=True), strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all((int(r.fingerprint, 16), r.component_id) == want[r.doc_id] for r in got)
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {c for _, c in want.values()}


@pytest.mark.parametrize("group_rows", [3, 20_000])
def test_trie_join_with_hot_blocks(spark, monkeypatch, group_rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for b in base * 3] + [base[0] ^ i for i in range(200)] + [0, 3, 3]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame(list(enumerate(signed)), "id bigint, fp bigint")
    got = {r.fp: r.component_id for r in simhash.class_ids(rows, "fp", "id").collect()}
    assert [got[f] for f in signed] == brute_components(fps, range(len(fps)))


def test_simhash_of_odd_rows(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id in (1, 2)} == {(1, "0" * 16, 1), (2, "0" * 16, 1)}
    assert {r.component_id for r in got if r.doc_id in (3, None)} == {3}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]
    nulls = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id bigint, text string")
    assert simhash.keep_one(nulls).count() == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (200, 100), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# 9
def test_language_id(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    profiles = langid.train(docs)
    got = langid.identify(docs, profiles).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    rows = {r.doc_id: r for r in langid.identify(odd, profiles).collect() if r.doc_id}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[4].lang_pred == "und" and rows[5].lang_pred in profiles.languages
    assert langid.identify(empty, profiles).count() == 0
    assert langid.identify(odd, langid.Profiles([], [])).filter("lang_pred <> 'und'").isEmpty()
    kept = langid.keep_identified(odd, profiles)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {3, None}


def test_ngrams_in_pieces_and_by_hand(monkeypatch):
    text = "Ab, ab! éa  " * 20
    whole = langid.ngrams(text)
    monkeypatch.setattr(langid, "PIECE", 7)
    pieces = langid.ngrams(text)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    letters = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    want = {}
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            g = letters[i : i + n]
            if g != " ":
                want[g] = want.get(g, 0) + 1
    assert sorted(want.values()) == sorted(whole[1].tolist())


def test_distances_by_hand(spark, sf):
    """Profiles, ranks and the out-of-place distance, computed a second way."""
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text]
    profiles = langid.train(spark.createDataFrame(rows))

    def ranked(texts):
        total = {}
        for t in texts:
            for g, n in zip(*langid.ngrams(t), strict=True):
                total[int(g)] = total.get(int(g), 0) + int(n)
        return sorted(total, key=lambda g: (-total[g], g))[: langid.RANKS]

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    own = {lang: {g: k for k, g in enumerate(ranked([r.text for r in rows if r.lang == lang and not held(r.doc_id)]))} for lang in {r.lang for r in rows if r.lang}}
    assert profiles.languages == sorted(own)
    for r in rows[:60]:
        grams = ranked([r.text])
        want = [sum(abs(own[lang][g] - k) if g in own[lang] else langid.RANKS for k, g in enumerate(grams)) for lang in profiles.languages]
        assert profiles.distances(langid.top(*langid.ngrams(r.text))).tolist() == want
        lang, score = profiles.predict(r.text)
        if grams:
            assert lang == profiles.languages[want.index(min(want))] and abs(score - (1 - min(want) / (langid.RANKS * len(grams)))) < 1e-12
        else:
            assert lang == langid.UNKNOWN


# 10
def test_decontamination_against_brute_force(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, decontaminate.normalized(r.text)) for r in bench.collect()]
    got = {r.doc_id: set(r["items"]) for r in decontaminate.contamination(docs, bench).collect()}
    for r in docs.collect():
        low = decontaminate.normalized(r.text)
        assert {i for i, t in items if t in low} <= got[r.doc_id]
        for i, t in items:
            if i in got[r.doc_id]:
                assert decontaminate.myers(t, low)[0] <= 0.2 * len(t)
    assert decontaminate.keep_uncontaminated(docs, bench).count() == sum(not x for x in got.values())


def test_recall_of_edited_passages(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng, texts, want = random.Random(2), [], []
    for i, t in items * 3:
        words = t.split()
        for _ in range(2):
            words[rng.randrange(len(words))] = "qq"
        texts.append(" ".join(["pad"] * rng.randrange(30) + words + ["pad"] * 9))
        want.append(i)
    got = list(decontaminate.Index(items).search(pa.array(texts)))
    assert sum(w in {g[0] for g in r} for w, r in zip(want, got, strict=True)) >= 0.95 * len(want)


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_up_to_the_edits_allowed(spark, sf, share):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rng, texts, want = random.Random(3), [], []
    for i, t in items * 4:
        c = list(t)
        for p in rng.sample(range(len(c)), int(share * len(decontaminate.normalized(t)))):
            x = rng.choice("abcdefghijklmnopqrstuvwxyz")
            c[p] = rng.choice((x, "", c[p] + x))
        own, edited = decontaminate.normalized(t), "".join(c)
        if decontaminate.myers(own, decontaminate.normalized(edited))[0] > share * len(own):
            continue  # an edit beside punctuation can count twice
        texts.append(" ".join(["pad"] * rng.randrange(30) + [edited] + ["pad"] * 9))
        want.append(i)
    got = list(decontaminate.Index(items).search(pa.array(texts)))
    assert sum(w in {g[0] for g in r} for w, r in zip(want, got, strict=True)) >= 0.9 * len(want)


def test_every_item_within_the_limit_is_found(spark, sf):
    """Brute force over all pairs of a text and an item: 0.9 at least of those within the limit, and no other."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:12]
    rng = random.Random(7)
    texts = [decontaminate.edited(t, s, decontaminate.np.random.Generator(decontaminate.np.random.PCG64(rng.randrange(10**6)))) + " and so on" for _, t in items for s in (0.1, 0.17, 0.22)]
    got = list(decontaminate.Index(items).search(pa.array(texts)))
    right = total = 0
    for text, found in zip(texts, got, strict=True):
        low = decontaminate.normalized(text)
        for i, t in items:
            own = decontaminate.normalized(t)
            within = decontaminate.myers(own, low)[0] <= int(0.2 * len(own))
            total += within
            right += within and i in {g[0] for g in found}
            assert within or i not in {g[0] for g in found}
    assert total >= 24 and right >= 0.9 * total


def test_typography_is_no_edit():
    words = "Élan vital überall façade naïve réseau où le père s'éleva très haut mais déjà l'été s'achève près du théâtre où l'âme rêve encore"
    items = [(1, words), (2, "the quick brown fox jumps over the lazy dog and runs far away from the old mill by the river")]
    texts = [words.upper(), "\u201c" + words.replace(" ", "\u201d \u201c") + "\u201d", words.replace(" ", "\u00a0"), words.replace(" ", "\u2003\u2014 "), "x \u0130 " + words + " y"]
    got = list(decontaminate.Index(items).search(pa.array(texts)))
    assert [[(g[0], g[1]) for g in found] for found in got] == [[(1, 0)]] * len(texts)
    for text, found in zip(texts, got, strict=True):
        part = text.encode()[found[0][2] : found[0][3]].decode()
        assert decontaminate.normalized(words) in decontaminate.normalized(part)


def test_normalised_texts_by_hand(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["".join(map(chr, range(128))), "A_b-C'd 1.5\x1c\x1fE", "", " \t"]
    assert all(decontaminate.normalized(t) == " ".join(decontaminate.WORDS.findall(t.lower())) for t in texts)


def test_pieces_only_rule_out_what_is_beyond_the_limit():
    np = decontaminate.np
    rng = random.Random(8)
    for alphabet in ("abcde ", "aéß日 "):
        patterns = [decontaminate.normalized("x" + "".join(rng.choices(alphabet, k=rng.randrange(1, 200)))) for _ in range(30)]
        texts = []
        for own in patterns:
            c = list(own)
            for p in rng.sample(range(len(c)), rng.randrange(0, len(c) // 3 + 1)):
                c[p] = rng.choice((rng.choice(alphabet), "", c[p] + "日"))
            texts.append(rng.choice(("", "zz ")) + "".join(c) + rng.choice(("", " aé")))
        parts = [decontaminate.piece_masks(decontaminate.char_codes(np.frombuffer(p.encode(), np.uint8))[0]) for p in patterns]
        codes, char_of = decontaminate.char_codes(np.frombuffer("".join(texts).encode(), np.uint8))
        ends = np.cumsum([len(t) for t in texts])
        assert len(codes) == ends[-1]
        begin, end = ends - [len(t) for t in texts], ends
        sizes = [len(m) for m, _ in parts]
        got = decontaminate.least_distances(np.concatenate([m for m, _ in parts]), np.concatenate([b for _, b in parts]), codes, np.repeat(begin, sizes), np.repeat(end, sizes))
        at = 0
        for own, text, n in zip(patterns, texts, sizes, strict=True):
            exact = [decontaminate.myers(own[64 * k : 64 * k + 64], text)[0] for k in range(n)]
            assert all(g <= e for g, e in zip(got[at : at + n], exact, strict=True)) and got[at : at + n].sum() <= decontaminate.myers(own, text)[0]
            if alphabet.isascii() and text.isascii():
                assert got[at : at + n].tolist() == exact
            at += n


def test_myers_stops_only_beyond_most():
    rng = random.Random(6)
    for _ in range(300):
        p, t = ("".join(rng.choices("ab", k=rng.randrange(1, 12))) for _ in range(2))
        exact = decontaminate.myers(p, t)
        for most in range(4):
            d = decontaminate.myers(p, t, most)
            assert d == exact if exact[0] <= most else d[0] > most


def test_myers_by_hand():
    rng = random.Random(4)
    for _ in range(200):
        p, t = ("".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(2))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (c != d)))
            row = new
        assert decontaminate.myers(p, t)[0] == min(row)


def test_decontamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "some words here today"), (2, None), (3, ""), (None, "another item of words"), (1, "some words here today")], "item_id bigint, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.contamination(odd, bench).collect()}
    assert got[3] == got[None] == [1] and got[1] == got[2] == got[4] == []
    nameless = decontaminate.contamination(spark.createDataFrame([(9, "so another item of words it is")], "doc_id bigint, text string"), bench).first()
    assert nameless["items"] == [None] and nameless.contaminated
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.filter("false")).filter("contaminated").isEmpty()


def test_least_distances_of_stretches_of_any_lengths():
    import numpy as np

    from weftline.llm import decontaminate as d

    rng = np.random.Generator(np.random.PCG64(17))
    text = "".join(rng.choice(list("abcd"), 900))
    begin = rng.integers(0, 500, 70)
    end = begin + rng.integers(0, 400, 70)
    items = ["".join(rng.choice(list("abcd"), n)) for n in rng.integers(1, 65, 70)]
    masks, last = (np.concatenate(x) for x in zip(*(d.piece_masks(d.char_codes(np.frombuffer(t.encode(), np.uint8))[0]) for t in items), strict=True))
    got = d.least_distances(masks, last, d.char_codes(np.frombuffer(text.encode(), np.uint8))[0], begin, end)
    assert got.tolist() == [d.myers(t, text[a:b])[0] for t, a, b in zip(items, begin, end, strict=True)]
