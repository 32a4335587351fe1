"""The whole pipeline against its stages by SQL and by hand, and what it leaves in the shared folder."""

from __future__ import annotations

import math
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F
from test_methods import brute_components

import corpus_pipeline
from stallwise.llm import materialise
from stallwise.llm.oracle import ORACLE
from stallwise.sources import staging

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def expected():
    """Documents that should come through each stage, and the words taken of each in the end."""
    db = duckdb.connect()
    db.execute(f"CREATE TABLE documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    db.execute(f"CREATE TABLE benchmark AS SELECT * FROM '{SF_DIR}/benchmark.parquet'")

    def rows(sql):
        return db.execute(sql).fetchall()

    def only(ids):
        db.execute("CREATE OR REPLACE TABLE kept(id BIGINT)")
        db.executemany("INSERT INTO kept VALUES (?)", [[i] for i in sorted(ids)])
        db.execute("DELETE FROM documents WHERE doc_id NOT IN (SELECT id FROM kept)")

    stages = []
    good = {i for (i,) in rows(f"SELECT doc_id FROM ({ORACLE['op4_quality_rules']}) WHERE kept")}
    stages.append(good)
    only(good)
    low = brute_components(dict(rows("SELECT doc_id, text FROM documents")))
    stages.append({i for i, least in low.items() if i == least})
    only(stages[-1])
    bad = {i for (i,) in rows(f"SELECT doc_id FROM ({ORACLE['op1_decontaminate']}) WHERE contaminated")}
    stages.append(stages[-1] - bad)
    only(stages[-1])
    taken = dict(rows(f"SELECT doc_id, taken FROM ({ORACLE['op9_mix']})"))
    return stages, taken, dict(rows("SELECT doc_id, text FROM documents"))


def test_stages_by_sql_and_by_hand(spark, expected, tmp_path):
    stages, taken, texts = expected
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for number, (_, step) in enumerate(corpus_pipeline.STAGES[:3]):
        step(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        assert sorted(r.doc_id for r in docs.collect()) == sorted(stages[number])
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, SF_DIR)
    mixed.write.parquet(f"{tmp_path}/3")
    docs = spark.read.parquet(f"{tmp_path}/3")
    words = {}
    for r in docs.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert words == {i: n for i, n in taken.items() if n}

    rows = corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR).collect()
    encoder = materialise._encoder(Path(materialise.VOCABULARY).read_bytes(), "test")
    tokens = sum(len(encoder.encode_ordinary(r.text)) + 1 for r in docs.collect() if r.text)
    assert sorted(r.slot for r in rows) == list(range(math.ceil(tokens / materialise.LENGTH)))
    assert {i for r in rows for i in r.doc_ids} == {i for i, n in taken.items() if n} and set(words) <= set(texts)


def test_run_gives_the_same_and_keeps_little(spark, expected):
    _, taken, _ = expected
    found = corpus_pipeline.run(spark, SF_DIR)
    rows = found.collect()
    again = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert {i for r in rows for i in r.doc_ids} == {i for i, n in taken.items() if n}
    kept = {Path(p).name.rsplit("-", 1)[0] for p in corpus_pipeline._kept[spark.sparkContext.applicationId]}
    assert "stage3" in kept and not kept & {"stage0", "stage1", "stage2", "quality", "fingerprints", "verified"}


def test_documents_that_are_still_read_stay(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("doc_id < 60")
    first = corpus_pipeline.quality_rules(spark, docs, SF_DIR)  # not written
    second = corpus_pipeline.near_duplicates(spark, first, SF_DIR)
    assert 0 < second.count() <= first.count()
    other = staging.stage(spark.range(3), "other")
    corpus_pipeline.benchmark_decontamination(spark, docs, SF_DIR).count()
    assert other.where(F.col("id") >= 0).count() == 3  # not a stage's
