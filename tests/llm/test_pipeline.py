"""The pipeline's stages one by one on a small corpus."""

import pytest

import corpus_pipeline
from corpusledger.llm import exact_dedup, mixing
from corpusledger.llm.queries import ORACLES, QUERIES
from tests.llm.test_near import left_by_hand
from tests.oracle import duck, same


@pytest.fixture(scope="module")
def stages(spark, data):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, data), "test")
        out[name] = docs
    return out


def test_stages_keep_the_columns(spark, data, stages):
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    assert all(stages[n].columns == columns for n in list(stages)[:-1])


def test_stages_do_what_they_say(spark, data, stages):
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in stages.items()}
    start = [r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()]
    assert len(ids["language_id"]) > 0.95 * len(start)
    kept = exact_dedup.exact_dedup(stages["language_id"]).filter("kept").select("doc_id").collect()
    assert sorted(ids["exact_dedup"]) == sorted(r.doc_id for r in kept)
    near = left_by_hand([tuple(r) for r in stages["exact_dedup"].select("doc_id", "text").collect()])
    assert sorted(ids["near_dedup"]) == sorted(d for d, _ in near)
    copies = mixing.mix(stages["near_dedup"], spark.read.parquet(f"{data}/labels.parquet"), cut_last=False).collect()
    assert sorted(ids["mixing"]) == sorted(r.doc_id for r in copies for _ in range(r.copies))
    assert set(ids["packing"]) == set(ids["mixing"])


def test_run_equals_the_stages(spark, data, stages):
    want, got = stages["packing"], corpus_pipeline.run(spark, data)
    columns = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    total = lambda df: df.selectExpr("sum(length)", "count(distinct doc_id)").first()
    assert total(got) == total(want) and got.select(columns).distinct().count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, data, name):
    same(QUERIES[name](spark, data), duck(data), ORACLES[name])
