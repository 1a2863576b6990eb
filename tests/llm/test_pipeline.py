"""The pipeline against each stage done by hand on the rows that the one before left."""

import corpus_pipeline
import sentencepiece
from test_similar import shingles

from weftline import staging
from weftline.llm import decontaminate, langid, sentencepieces, toxicity


def kept_by_similarity(rows):
    """The smallest id of each chain of texts with a five-word similarity of 0.8; texts without words are alike."""
    ids = sorted(rows)
    sets, root = {i: shingles(rows[i]) for i in ids}, {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in ids}


def test_pipeline_by_hand(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}

    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = {i: t for i, t in rows.items() if model.score(t) < model.threshold}
    profiles = langid.train(docs.filter(docs.doc_id.isin(*left)))
    left = {i: t for i, t in left.items() if profiles.predict(t)[0] in profiles.languages}
    left = {i: left[i] for i in kept_by_similarity(left)}
    items = [decontaminate.normalized(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for i, t in left.items():
        low = decontaminate.normalized(t)
        if any(x in low for x in items):
            assert i not in out
        elif i not in out:
            assert any(decontaminate.myers(x, low)[0] <= 0.2 * len(x) for x in items)
    assert set(out) <= set(left)
    s = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.DEFAULT_MODEL)
    assert all(r.token_ids == s.encode(rows[i]) and r.n_tokens == len(r.token_ids) and r.round_trip for i, r in out.items())


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_dedup", "decontamination", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs.filter("false"), sf).count() == 0


def test_odd_rows_and_clashing_names_go_through(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    text = docs.filter("length(text) > 300").first().text
    kind = docs.schema
    odd = spark.createDataFrame([(None, text + " tail", "en", "s", 1), (900001, None, None, None, None), (900002, "", "en", "s", 0), (None, None, None, None, None), (900003, "!! 12", "en", "s", 5), (900004, "word and then " * 30_000, "en", "s", 9)], kind)
    twice = docs.limit(5)
    clash = ["fp", "row", "digest", "judged", "found", "lang_of", "node", "root", "label"]
    rows = docs.unionByName(odd).unionByName(twice)
    for c in clash:
        rows = rows.selectExpr("*", f"cast(doc_id as string) as {c}")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").unionByName(spark.read.parquet(f"{sf}/{t}.parquet").selectExpr(*(f"cast(null as {k}) as {n}" for n, k in spark.read.parquet(f"{sf}/{t}.parquet").dtypes)).limit(1)).write.parquet(str(tmp_path / f"{t}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids)) and not {900001, 900002, 900003} & set(ids) and all(r.round_trip for r in out)
    assert len(out) <= 122
    spark.read.parquet(f"{sf}/documents.parquet").filter("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_a_run_leaves_only_its_stages(spark, sf):
    staging.release(spark)
    corpus_pipeline.run(spark, sf).count()
    assert staging.release(spark) == len(corpus_pipeline.STAGES)
