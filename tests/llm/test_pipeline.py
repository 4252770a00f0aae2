"""Each stage of the pipeline against plain Python over the rows that it gets."""

import itertools
from pathlib import Path

import pytest

import corpus_pipeline
from tidewarden.llm import decontaminate, langid, neardup, queries, tokens, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    if not Path(SF, "documents.parquet").exists():
        pytest.skip("no test tables")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        out.append((name, docs, docs.collect(), got.columns, rows))
        docs = spark.createDataFrame(rows, got.schema)
    return {name: rest for name, *rest in out}


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_stages_keep_the_columns(stages):
    for name, (_, before, columns, after) in stages.items():
        if name != "best_fit_packing":
            assert columns == before[0].__fields__ and set(after) <= set(before), name


def test_language_id(spark, stages):
    _, before, _, after = stages["language_id"]
    model = tuple(sorted(queries.language_model(spark, SF).items()))
    assert ids(after) == sorted(r.doc_id for r in before if not langid.identify(r.text, model)[2])


def test_toxicity(spark, stages):
    _, before, _, after = stages["toxicity"]
    model = toxicity._loaded(queries.toxicity_model(spark, SF))
    assert ids(after) == sorted(r.doc_id for r in before if toxicity.score(r.text, *model) < 0.5)


def test_near_dedup(stages):
    _, before, _, after = stages["simhash_near_dedup"]
    fps = {r.doc_id: neardup.simhash(r.text) & (1 << 64) - 1 for r in before}
    root = {i: i for i in fps}
    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert ids(after) == sorted(set(root.values())) and len(after) < len(before)


def test_decontamination(spark, stages):
    docs, before, _, after = stages["benchmark_decontamination"]
    bad = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    exact = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holding = {r.doc_id for r in before if any(x in " ".join(r.text.lower().split()) for x in exact)}
    assert ids(after) == sorted({r.doc_id for r in before} - bad) and holding <= bad


def test_packing(stages):
    _, before, _, after = stages["best_fit_packing"]
    count = tokens.counter(queries.packing.public_tokenizers.path("word_bpe_49k.json"))
    total = {}
    for r in after:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {r.doc_id: count(r.text) + 1 for r in before}
