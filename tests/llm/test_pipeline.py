"""The pipeline, stage by stage, against brute force; its guard in the entry point."""

import corpus_pipeline
from boutwright.llm import repeats
from boutwright.llm.common import materialise
from tests.conftest import DATA
from tests.llm.test_operators import cut_all, figures, low_words, shingles, slow_components, slow_fingerprint


def test_stages_against_brute_force(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "best_fit_packing"]
    took = lambda name, df: materialise(stage[name](spark, df, d), name)

    good = took("quality_rules", docs)
    assert good.columns == docs.columns
    whole = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert kept and all(kept[i] == whole[i] and not figures(whole[i])[-1] for i in kept)

    single = took("simhash_near_dedup", good)
    parts = slow_components([(i, slow_fingerprint(t)) for i, t in kept.items()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in parts})

    left = took("suffix_array_dedup", single)
    rows = sorted((r.doc_id, r.text) for r in single.collect())
    want = {i: (n - gone, data) for (i, _), (n, gone, _, data) in zip(rows, cut_all((t for _, t in rows), repeats.PASSAGE))}
    for r in left.collect():
        assert r.text == want[r.doc_id][1].decode("utf-8", "ignore") and r.n_chars == len(r.text)
    assert left.columns == docs.columns and left.count() == len(want)

    clean = took("benchmark_decontamination", left)
    items = [shingles(ws, min(5, len(ws))) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if (ws := low_words(r.text))]
    wide = {len(next(iter(s))) for s in items}
    has = {r.doc_id: {w: shingles(low_words(r.text), w) for w in wide} for r in left.collect()}
    bad = {i for i, own in has.items() if any(len(s & own[len(next(iter(s)))]) >= 0.8 * len(s) for s in items)}
    assert {r.doc_id for r in clean.collect()} == has.keys() - bad

    packed = stage["best_fit_packing"](spark, clean, d).collect()
    assert {r.doc_id for r in packed} == has.keys() - bad
    again = corpus_pipeline.run(spark, d).collect()
    key = lambda x: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in x)
    assert key(again) == key(packed)


def test_empty_tables(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, d)
        assert out.count() == 0
        if name != "best_fit_packing":
            assert out.columns == docs.columns
