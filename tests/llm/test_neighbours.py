"""Nearest-neighbour voting against all cosines in plain numpy, and on held-out rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stallwise.llm import neighbours as N
from stallwise.llm.common import table
from stallwise.llm.queries import op12_neighbours

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"word{i * 7919 % 20011}" for i in range(40_000))


def by_hand(text: str | None) -> dict[str, float]:
    """Shares of words in repeated windows, of upper case and of digits."""
    words = (text or "").split()
    windows = [tuple(w.lower() for w in words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + i for k, w in enumerate(windows) if windows.count(w) > 1 for i in range(3)}
    return {"repeated": len(inside) / max(len(words), 1), "words": len(words)}


TEXTS = [None, "", "  \n", "one", "a b c a b c", "A b c a B c d", "x! y! é ü", "1 2 3 4", "w w w w w", "a b c d e a b"]


def test_repeated_words():
    shares = N.term_shares(pa.array(TEXTS, pa.string()))
    low = N.STARTS["repeats"]
    for text, row in zip(TEXTS, shares):
        truth = by_hand(text)
        assert bool(row[low]) == (truth["words"] > 0)
        assert row[low + 1 : low + 1 + len(N.REPEATED)].tolist() == [truth["repeated"] > s for s in N.REPEATED]


def test_terms_do_not_hang_on_the_batch():
    texts = [*TEXTS, LONG, "ALL CAPS!! HERE!!"]
    together = N.term_shares(pa.array(texts, pa.string()))
    alone = np.concatenate([N.term_shares(pa.array([t], pa.string())) for t in texts])
    sliced = N.term_shares(pa.array(["before", *texts], pa.string()).slice(1))
    assert np.array_equal(together, alone) and np.array_equal(together, sliced)


def test_shapes_and_signs_are_told_apart():
    rows = N.term_shares(pa.array(["word", "WORD", "w0rd", "word!!", "word!"], pa.string()))
    shapes = rows[:, N.STARTS["shapes"] : N.STARTS["signs"]]
    assert len({r.tobytes() for r in shapes[:4]}) == 4 and shapes[3].tobytes() == shapes[4].tobytes()


def plain_scores(model: N.Model, shares: np.ndarray) -> np.ndarray:
    """All cosines at once, sorted."""
    cosines = np.rint(model.latent(shares) @ model.vectors.T * N.STEPS) / N.STEPS
    out = []
    for row, known in zip(cosines, shares[:, N.STARTS["repeats"]]):
        near = sorted(range(len(row)), key=lambda k: (-row[k], k))[: N.NEIGHBOURS]
        votes = [max(row[k], 0) ** N.POWER * model.weights[k] if known else 0.0 for k in near]
        weak = 1e-6 * model.weights.mean()
        ones = sum(v for v, k in zip(votes, near) if model.labels[k] == 1)
        out.append((ones + weak * model.prior) / (sum(votes) + weak))
    return np.array(out)


def test_whole_query_against_all_cosines(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 37)
    documents, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    learned = documents.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = N.train(learned, labels, texts=60)
    assert len(model.vectors) <= 120 and len(model.vectors) > 37
    # The model again from the same rows, without Spark.
    rows = learned.join(labels, "doc_id").select("doc_id", "quality", "text", F.expr("abs(xxhash64(doc_id) % 1000000)").alias("draw"))
    rows = sorted(rows.collect(), key=lambda r: (r.draw, r.doc_id))
    drawn = [r for k in (0, 1) for r in sorted([r for r in rows if r.quality == k][:60], key=lambda r: r.doc_id)]
    again = N.fit(
        np.array([r.quality for r in drawn]), N.term_shares(pa.array([r.text for r in drawn])),
        {k: sum(r.quality == k for r in rows) for k in (0, 1)},
    )
    assert np.allclose(again.vectors, model.vectors) and np.allclose(again.weights, model.weights)
    found = {r.doc_id: r.score for r in N.score(documents, model).collect()}
    texts = documents.select("doc_id", "text").collect()
    expected = plain_scores(model, N.term_shares(pa.array([r.text for r in texts], pa.string())))
    assert len(found) == len(texts)
    assert np.allclose([found[r.doc_id] for r in texts], expected, atol=1e-4)


def test_held_out_rows(spark):
    scored = op12_neighbours(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("held_out").toPandas()
    good, bad = scored[scored.quality == 1].score, scored[scored.quality == 0].score
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) > 5 and auc > 0.97 and (good >= 0.7).mean() > 0.97


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, LONG), (4, LONG), (None, "no id"), (5, "AAA!! BBB!!"), (6, "fine words")]
    names = ("label", "row", "score", "draw", "shares", "n")
    documents = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *(F.lit(c).alias(c) for c in names))
    labels = spark.createDataFrame([(5, 0), (5, 1), (4, 1), (6, 1), (7, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    model = N.train(documents, labels.withColumn("label", F.lit(9)))
    assert model.prior == pytest.approx(2 / 3) and len(model.vectors) == 3
    found = N.score(documents, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    scores = {r.doc_id: r.score for r in found}
    assert scores[1] == scores[2] == pytest.approx(2 / 3) and scores[5] < 0.5 < scores[4]
    nothing = spark.createDataFrame([], documents.schema)
    assert N.score(nothing, model).count() == 0
    assert {r.score for r in N.score(documents, N.train(nothing, labels)).collect()} == {0.5}
    one = N.train(documents, labels.where("doc_id = 4"))
    assert {r.score for r in N.score(documents, one).collect()} == {1.0}
