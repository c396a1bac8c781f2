"""The pipeline against plain Python, stage by stage and as a whole."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offerlake.llm import langid
from offerlake.llm.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.llm.test_decontam import distance_to_run
from tests.llm.test_neardup import LOWER, WORD, brute


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL).persist()
        out.append((name, docs))
    return out


def test_stage_names():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "packing"]


def test_every_stage_against_plain_python(spark, stages):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    columns = spark.read.parquet(f"{SF_SMALL}/documents.parquet").columns
    tables = [df.collect() for _, df in stages]
    assert all(df.columns == columns for _, df in stages[:-1])
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    found = {r.doc_id: r for r in langid.identify(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), train).collect()}
    kept = {r.doc_id for r in tables[0]}
    assert kept == {r.doc_id for r in rows if found[r.doc_id].lang_pred != "und" and found[r.doc_id].score >= 0.5}
    label = brute([(r.doc_id, r.text) for r in tables[0]], 80)
    assert {r.doc_id for r in tables[1]} == set(label.values())
    items = [WORD.findall(r.text.translate(LOWER)) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    shared = [{w for w in item} for item in items]
    dirty = set()
    for r in tables[1]:
        words = WORD.findall(r.text.translate(LOWER))
        own = set(words)
        for item, vocabulary in zip(items, shared, strict=True):
            edits = len(item) * 20 // 100
            if sum(w in own for w in item) >= len(item) - edits and len(vocabulary & own) and r.doc_id not in dirty:
                if distance_to_run(item, words) <= edits:
                    dirty.add(r.doc_id)
    assert {r.doc_id for r in tables[2]} == {r.doc_id for r in tables[1]} - dirty and dirty
    assert {(r.doc_id, r.n_tokens) for r in tables[3]} == {(r.doc_id, len(WORD.findall(r.text)) + 1) for r in tables[2]}


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF_SMALL).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_a_query_of_each_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_SMALL).collect() == []
