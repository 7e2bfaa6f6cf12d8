"""The pipeline's stages, each against a brute-force version on its own input, and unusual tables."""

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import decontam, langid, mixing
from quern.llm.store import Scratch

from .test_operators import DOC, brute_groups, brute_words, odd_rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch, docs, out = Scratch(spark, "test"), spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        after = scratch.write(f(spark, docs, SMALL), name)
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage(spark, stages):
    before, after = stages[0]
    model = langid.train(before)
    t = before.toArrow().combine_chunks()
    keep = langid.predict(model, t["text"].combine_chunks())[0] != "und"
    want = [r for r, k in zip(rows(before), keep) if k]
    assert sorted(rows(after)) == sorted(want) and after.schema == before.schema


def test_dedup_stage(spark, stages):
    before, after = stages[1]
    gone = {a for a, _ in brute_groups([(r.doc_id, r.text) for r in before.collect()])}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] not in gone) and gone


def test_decontamination_stage(spark, stages):
    before, after = stages[2]
    items = [brute_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]

    def holds(t):
        w = brute_words(t)
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for p in items:
            if any(tuple(p[k : k + 5]) in grams for k in range(len(p) - 4)):
                ids = {x: n for n, x in enumerate({*w, *p})}
                tiles = decontam.tile(np.array([ids[x] for x in p], np.uint64), np.array([ids[x] for x in w], np.uint64))
                if sum(x[0] for x in tiles) >= decontam.COVERAGE * len(p):
                    return True
        return False

    bad = {r.doc_id for r in before.collect() if holds(r.text)}
    assert bad and sorted(rows(after)) == sorted(r for r in rows(before) if r[0] not in bad)


def test_mixing_stage(spark, stages):
    before, after = stages[3]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rate = {r.doc_id: r.rate for r in mixing.document_rates(before, labels, spark).collect()}
    copies = {}
    for r in rows(after):
        copies[r[0]] = copies.get(r[0], 0) + 1
    for r in rows(before):
        assert np.floor(rate[r[0]] - 1e-5) <= copies.get(r[0], 0) <= np.floor(rate[r[0]] + 1e-5) + 1
    assert set(rows(after)) <= set(rows(before)) and len(copies) > 0.6 * before.count()


def test_sharding_stage(spark, stages):
    before, after = stages[4]
    assert after.columns == [*before.columns, "shard", "shard_bytes", "manifest_version"]
    assert sorted(rows(after.select(before.columns))) == sorted(rows(before))


def test_run_equals_the_stages(spark, stages):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() == stages[-1][1].count()


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_unusual_tables(spark, tmp_path, which):
    d = str(tmp_path)
    spark.createDataFrame(odd_rows() if which == "odd" else [], DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "same text of nine words that is repeated here"), (None, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (8, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = corpus_pipeline.run(spark, d)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id for r in out.collect()}
    assert kept <= ({4, 8} if which == "odd" else set())
