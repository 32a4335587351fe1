"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator and stage."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stallwise.llm import (
    decontaminate,
    hosts,
    jaccard,
    languages,
    materialise,
    mixing,
    pseudonyms,
    quality,
    toxicity,
    warc,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i * 7919 % 20011}" for i in range(30_000))
ROWS = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, "a", 4),
    (4, "one", "en", None, 3),
    (5, LONG, "en", "a", len(LONG)),
    (5, LONG, "en", "a", len(LONG)),
    (6, LONG, "en", None, len(LONG)),
    (None, "words without an id here", "en", "b", 24),
    (None, None, None, None, None),
]
# Names that the operators use themselves.
CLASHING = ("row", "digest", "key", "id", "w", "n", "s", "host", "n_words", "spans", "copy", "kept", "bucket", "size")


@pytest.fixture(scope="module")
def documents(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    return frame.select("*", *(F.lit(name).alias(name) for name in CLASHING))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    window = " ".join(LONG.split()[100:112])
    rows = [(1, window), (1, window), (2, None), (3, ""), (None, "... !"), (4, "ONE"), (None, "without an ID")]
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumn("n_words", F.lit(1))


def by_id(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.where("doc_id IS NOT NULL").collect())


def test_decontaminate(documents, nothing, benchmark):
    found = decontaminate.find(documents, benchmark)
    assert found.count() == len(ROWS)
    rows = by_id(found, "doc_id", "n_words", "n_hit", "n_items")
    assert rows == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 1, 1, 1), *[(5, 30_000, 24, 1)] * 2, (6, 30_000, 24, 1)]
    assert {r.items_sha256 for r in found.where("n_items = 0").collect()} == {hashlib.sha256(b"").hexdigest()}
    unnamed = found.where("doc_id IS NULL AND n_words > 0").first()
    assert (unnamed.n_hit, unnamed.n_items, unnamed.items_sha256) == (3, 1, hashlib.sha256(b"").hexdigest())
    assert decontaminate.find(nothing, benchmark).count() == 0
    clean = decontaminate.find(documents, benchmark.limit(0))
    assert clean.count() == len(ROWS) and clean.where("contaminated").count() == 0
    assert [i for i, in by_id(decontaminate.remove(documents, benchmark), "doc_id")] == [1, 2, 3]
    assert decontaminate.remove(documents, benchmark).columns == documents.columns


def test_windows_of_short_items_and_hits_that_touch(spark):
    items = spark.createDataFrame([(1, "a b"), (2, "b c d"), (3, "x"), (4, "É e")], "item_id bigint, text string")
    texts = spark.createDataFrame(
        [(1, "A-b c, d a b"), (2, "b c x"), (3, "É E é e"), (4, "a  c")], "doc_id bigint, text string"
    )
    found = {r.doc_id: (r.n_hit, r.n_items, [tuple(s) for s in r.spans]) for r in decontaminate.find(texts, items).collect()}
    assert found == {1: (6, 2, [(0, 6)]), 2: (1, 1, [(2, 3)]), 3: (2, 1, [(0, 2)]), 4: (0, 0, [])}


def test_decontaminate_without_broadcast(spark, documents, benchmark):
    few = decontaminate.find(documents, benchmark, broadcast_rows=0)
    many = decontaminate.find(documents, benchmark)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_near_duplicates(documents, nothing):
    found = jaccard.near_duplicates(documents)
    assert found.count() == len(ROWS)
    rows = by_id(found, "doc_id", "n_shingles", "component_id")
    n = len({tuple(LONG.split()[i : i + 5]) for i in range(29_996)})
    assert rows == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, n, 5), (5, n, 5), (6, n, 5)]
    assert sorted(r.n_shingles for r in found.where("doc_id IS NULL").collect()) == [0, 1]
    assert found.where("doc_id IS NULL AND component_id IS NOT NULL").count() == 0
    assert jaccard.near_duplicates(nothing).count() == 0
    kept = jaccard.representatives(documents)
    assert kept.columns == documents.columns
    assert [i for i, in by_id(kept, "doc_id")] == [1, 2, 3, 4, 5] and kept.where("doc_id IS NULL").count() == 2


def test_rows_that_share_an_id_are_one_document(spark):
    words = [f"w{i}" for i in range(60)]
    first, second = " ".join(words), " ".join(reversed(words))
    rows = [(7, first), (7, second), (8, first), (9, second), (10, "else")]
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert by_id(found, "doc_id", "component_id") == [(7, 7), (7, 7), (8, 7), (9, 7), (10, 10)]


def test_quality(documents, nothing):
    judged = quality.judge(documents)
    rows = by_id(judged, "doc_id", "n_words", "n_repeat_words", "base_failed")
    assert rows[:4] == [(1, 0, 0, True), (2, 0, 0, True), (3, 0, 0, True), (4, 1, 0, True)]
    assert judged.count() == len(ROWS)
    assert quality.judge(nothing).count() == 0 and quality.keep(nothing).count() == 0
    assert quality.keep(documents).columns == documents.columns


def test_a_bad_host_takes_its_good_documents_along(spark):
    good, bad = " ".join(f"g{i}" for i in range(80)), "too short"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(200)] + [(i, good, f"h{i % 9}") for i in range(200, 600)]
    kept = {r.doc_id for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).where("kept").collect()}
    assert kept == set(range(200, 600))


def test_toxicity_without_labels(spark, documents, nothing):
    model = toxicity.train(documents, documents.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    scored = toxicity.score(documents, model)
    assert scored.count() == len(ROWS) and scored.where("score <> 0").count() == 0
    assert toxicity.score(nothing, model).count() == 0
    one = toxicity.train(documents, documents.select("doc_id", F.lit(1).alias("toxic")))
    assert toxicity.score(documents, one).where("score = 1").count() == len(ROWS)


def test_languages(documents, nothing):
    found = languages.predict(documents, languages.train(documents))
    assert found.count() == len(ROWS)
    rows = by_id(found, "doc_id", "lang_pred")
    assert rows == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "en"), (5, "en"), (6, "en")]
    unlearned = languages.predict(documents, languages.train(nothing))
    assert {r.lang_pred for r in unlearned.collect()} == {"und"}
    assert languages.predict(nothing, languages.train(documents)).count() == 0


def test_url_filter(spark):
    schema = "page_id bigint, url string"
    pages = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Org?x"), (5, "HTTP://A.Org?x"), (6, "x://b.org/a#c"), (None, "x://É.Com/fr/1")]
    outcomes = [(1, 1), (1, 0), (2, None), (None, 1), (99, 1)]
    frame = spark.createDataFrame(pages, schema).withColumn("host", F.lit(1)).withColumn("bad", F.lit("x"))
    rules = [("org", "/", "block"), ("b.org", "/a", "allow"), ("com", "/fr/", "block")]
    judged = hosts.filter_urls(frame, spark.createDataFrame(outcomes, "page_id bigint, bad int"), rules)
    rows = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in judged.collect()), key=str)
    assert rows == sorted([
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
        (5, "a.org", "", None, "allow"), (5, "a.org", "", None, "allow"), (6, "b.org", "/a", "b.org/a", "allow"),
        (0, "É.com", "/fr/1", "com/fr/", "block"),
    ], key=str)
    empty = spark.createDataFrame([], "page_id bigint, bad int")
    assert hosts.filter_urls(frame, empty, rules).count() == len(pages)
    assert hosts.filter_urls(frame.limit(0), empty, rules).count() == 0


def test_a_host_with_many_bad_pages_is_blocked(spark):
    pages = [(i, f"http://www.bad.net/{i}") for i in range(40)] + [(i, f"http://h{i % 7}.fine.net/{i}") for i in range(40, 300)]
    outcomes = [(i, int(i < 38)) for i in range(0, 300)]
    judged = hosts.filter_urls(
        spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(outcomes, "page_id bigint, bad int")
    )
    assert {r.page_id for r in judged.where("verdict = 'block'").collect()} == set(range(40))


def test_materialise(spark, documents, nothing):
    made = materialise.materialise(documents, length=64, per_shard=100)
    slots = sorted(r.slot for r in made.collect())
    assert slots == list(range(len(slots)))
    assert {i for r in made.collect() for i in r.doc_ids} == {3, 4, 5, 6, None}
    assert materialise.materialise(nothing).count() == 0
    assert materialise.materialise(documents.where("text IS NULL")).count() == 0


def test_mix(documents, nothing):
    mixed = mixing.mix(documents)
    assert mixed.count() == len(ROWS)
    rows = by_id(mixed, "doc_id", "size", "source_size")
    assert rows == [(1, 0, 60_000), (2, 0, 60_000), (3, 0, 60_000), (4, 1, 30_001), *[(5, 30_000, 60_000)] * 2, (6, 30_000, 30_001)]
    assert mixed.where("taken > 3 * size").count() == 0
    assert mixing.mix(nothing).count() == 0
    ordered = mixing.training_order(documents)
    assert ordered.columns == documents.columns
    taken = mixed.agg(F.sum("taken")).first()[0]
    assert ordered.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == taken
    assert mixing.training_order(nothing).count() == 0


def test_pseudonyms(documents, nothing):
    made = pseudonyms.pseudonymise(documents)
    assert made.count() == len(ROWS)
    assert {r.doc_id: r.text for r in made.where("doc_id < 5").collect()} == {1: None, 2: "", 3: " \n\t ", 4: "one"}
    assert made.where("n_replaced > 0").count() == 0
    assert set(CLASHING) <= set(made.columns)
    assert pseudonyms.pseudonymise(nothing).count() == 0


def test_warc(spark):
    same = "<p>" + "é" * 600
    rows = [(1, "http://a/", same), (2, None, same), (3, "http://b/\r\nWARC-Type: x", same), (3, "http://c", same)]
    rows += [(None, "http://d", same), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("value", F.lit(1))
    read = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes, r.intact) for r in warc.round_trip(pages).collect())
    assert read == sorted([
        ("1", "revisit", "3", 1203, True), ("2", "revisit", "3", 1203, True), ("None", "revisit", "3", 1203, True),
        ("3", "response", "None", 1203, True), ("3", "response", "None", 1203, True), ("4", "response", "None", 0, True),
        ("5", "response", "None", 0, True), ("6", "response", "None", 5, True), ("7", "response", "None", 5, True),
        ("8", "response", "None", 300_000, True),
    ])
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(spark, documents, nothing, name, stage):
    made = stage(spark, documents, "/root/testdata/sf0.001")
    assert made.dtypes == documents.dtypes
    made.count()
    assert stage(spark, nothing, "/root/testdata/sf0.001").count() == 0


def test_last_stage(spark, documents, nothing):
    stage = corpus_pipeline.STAGES[-1][1]
    assert stage(spark, documents, "").count() > 0
    assert stage(spark, nothing, "").count() == 0
