"""Quality classifier by nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are its words, the shapes of its words (runs of lower case, upper case and
digits as one sign each, others as they are), its signs other than letters, and the share of
its words that lie in three-word windows met more than once. Words, shapes and signs are
hashed to fixed slots and weighted by the root of their share of the text times the inverse
document frequency; each family has unit length. A singular value decomposition of the labelled texts
gives ``DIMENSIONS`` latent dimensions.

Labelled vectors are broadcast. Every document takes its exact cosine with all of them, in
blocks of ``BLOCK``; the ``NEIGHBOURS`` nearest vote with a power of their cosine, times the
rows of their class that each labelled text stands for. So the score estimates
the share of label 1 among texts like this one.

The model is fitted on at most ``TRAIN_TEXTS`` labelled texts a class, those with the least
hash of their id; their counts of terms (``FEATURES`` numbers each) are all that reaches the
driver. Scoring is one pass over whole texts in tasks, without a shuffle.

Edge cases: null and empty texts, and those without a word, have no neighbours and score
the share of label 1 among labelled rows. Without labelled texts of a class the score
is that share as well (0.5 without any). Texts of any length are read whole. Ties for the last
neighbour go to the labelled text that comes first by class and id. Rows that share an id
are scored each, and learned from once, by the least text. Labels that disagree on an id
count as 0. Rows without an id are scored, not learned from. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.common import arrow_rows
from stallwise.llm.shingles import mix, word_hashes
from stallwise.sources.staging import stage

TRAIN_TEXTS = 2000  # of each class
DIMENSIONS = 48
NEIGHBOURS = 25
POWER = 12  # of the cosine, in a vote
BLOCK = 1024  # labelled vectors compared at a time
STEPS, PLACES = 2**24, 2**24  # cosines are compared in steps of 1 / STEPS; at most PLACES labelled texts
THRESHOLD = 0.7
TEXT_ROWS = 128
WINDOW = 3  # words of a window that may repeat
REPEATED = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7)  # shares of repeated words that a text may exceed, a term each

# Slots and weight of each family of terms.
FAMILIES = {"words": (1024, 0.4), "shapes": (512, 1.0), "signs": (64, 1.0), "repeats": (len(REPEATED) + 1, 1.0)}
FEATURES = sum(slots for slots, _ in FAMILIES.values())
STARTS = dict(zip(FAMILIES, np.cumsum([0, *(slots for slots, _ in FAMILIES.values())])))

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = _CLASS[0x80:] = ord("l")
_CLASS[ord("A") : ord("Z") + 1] = ord("u")
_CLASS[ord("0") : ord("9") + 1] = ord("9")
_SIGN = np.array([not chr(b).isspace() and chr(_CLASS[b]) != "l" for b in range(256)])


def _owners(first: np.ndarray) -> np.ndarray:
    """The text of each word, from the first word of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _counted(owner: np.ndarray, slot: np.ndarray, rows: int, slots: int) -> np.ndarray:
    return np.bincount(owner * slots + slot, minlength=rows * slots).reshape(rows, slots)


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (mix(hashes, 31) % np.uint64(slots)).astype(np.int64)


def term_shares(texts: pa.Array) -> np.ndarray:
    """A row per text: the share of each slot's terms in its family; zeros without words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + rows + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    out = np.zeros((rows, FEATURES), np.float32)
    if not len(data):
        return out

    def put(family: str, counts: np.ndarray) -> None:
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        out[:, STARTS[family] : STARTS[family] + counts.shape[1]] = counts / total

    words, first = word_hashes(data, offsets)
    owner = _owners(first)
    put("words", _counted(owner, _slot(words, FAMILIES["words"][0]), rows, FAMILIES["words"][0]))

    classes = _CLASS[data]
    kept = np.ones(len(classes), bool)
    kept[1:] = classes[1:] != classes[:-1]
    kept[offsets[:-1][offsets[:-1] < len(data)]] = True
    shaped = classes[kept]
    shape_offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
    shapes, first_shape = word_hashes(shaped, shape_offsets)
    put("shapes", _counted(_owners(first_shape), _slot(shapes, FAMILIES["shapes"][0]), rows, FAMILIES["shapes"][0]))

    signs = np.flatnonzero(_SIGN[data])
    holder = np.searchsorted(offsets, signs, side="right") - 1
    slots = FAMILIES["signs"][0]
    found = _counted(holder, _slot(classes[signs].astype(np.uint64), slots), rows, slots)
    out[:, STARTS["signs"] : STARTS["signs"] + slots] = found / np.maximum(np.diff(offsets), 1)[:, None]

    repeated = _repeated_words(words, owner, rows)
    total = np.maximum(np.bincount(owner, minlength=rows), 1)
    bins = np.stack([repeated / total > share for share in REPEATED], axis=1)
    low = STARTS["repeats"]
    out[:, low] = np.bincount(owner, minlength=rows) > 0
    out[:, low + 1 : low + 1 + len(REPEATED)] = bins
    return out


def _repeated_words(words: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """How many words of each text lie in a window of words that its text holds more than once."""
    last = len(words) - WINDOW + 1
    if last <= 0:
        return np.zeros(rows, np.int64)
    window = mix(owner[:last].astype(np.uint64), 32)
    for k in range(WINDOW):
        window = mix(window + words[k : k + last], 33 + k)
    starts = np.flatnonzero(owner[:last] == owner[WINDOW - 1 :])
    _, place, times = np.unique(window[starts], return_inverse=True, return_counts=True)
    again = starts[times[place] > 1]
    inside = np.zeros(len(words), bool)
    for k in range(WINDOW):
        inside[again + k] = True
    return np.bincount(owner[inside], minlength=rows)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def weighted(shares: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Vectors of terms; each family has its weight as length."""
    vectors = np.sqrt(shares) * idf
    for family, (slots, weight) in FAMILIES.items():
        part = slice(STARTS[family], STARTS[family] + slots)
        vectors[:, part] = _unit(vectors[:, part]) * weight
    return vectors


@dataclass
class Model:
    prior: float  # share of label 1 among labelled rows
    idf: np.ndarray | None = None
    axes: np.ndarray | None = None  # FEATURES x DIMENSIONS
    vectors: np.ndarray | None = None  # labelled texts x DIMENSIONS, of unit length
    labels: np.ndarray | None = None
    weights: np.ndarray | None = None  # rows that a labelled text stands for

    def latent(self, shares: np.ndarray) -> np.ndarray:
        return _unit(weighted(shares, self.idf) @ self.axes)

    def score(self, shares: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Scores of texts from their term shares."""
        if self.vectors is None:
            return np.full(len(shares), self.prior)
        latent = self.latent(shares)
        # A key is a cosine and, below it, the place of the labelled text: no two are equal.
        best = np.empty((len(latent), 0), np.int64)
        for start in range(0, len(self.vectors), BLOCK):
            cosines = latent @ self.vectors[start : start + BLOCK].T
            place = PLACES - 1 - np.arange(start, start + cosines.shape[1])
            keys = np.concatenate([best, np.rint(cosines * STEPS).astype(np.int64) * PLACES + place], axis=1)
            best = np.partition(keys, -neighbours, axis=1)[:, -neighbours:] if keys.shape[1] > neighbours else keys
        near, who = best // PLACES / STEPS, PLACES - 1 - best % PLACES
        votes = np.maximum(near, 0.0) ** POWER * self.weights[who]
        votes[shares[:, STARTS["repeats"]] == 0] = 0
        weak = 1e-6 * self.weights.mean()
        return ((votes * self.labels[who]).sum(axis=1) + weak * self.prior) / (votes.sum(axis=1) + weak)


def fit(labels: np.ndarray, shares: np.ndarray, totals: dict[int, int], dimensions: int = DIMENSIONS) -> Model:
    """The model of labelled texts; ``totals`` are the labelled rows of each class."""
    everything = sum(totals.values())
    prior = totals.get(1, 0) / everything if everything else 0.5
    if len(set(labels.tolist())) < 2:
        return Model(prior)
    idf = (np.log((1 + len(shares)) / (1 + (shares > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = weighted(shares, idf).astype(np.float64)
    values, axes = np.linalg.eigh(vectors.T @ vectors)
    axes = axes[:, np.argsort(-values, kind="stable")[:dimensions]].astype(np.float32)
    model = Model(prior, idf, axes)
    model.vectors, model.labels = model.latent(shares).astype(np.float32), labels.astype(np.float64)
    stands = {label: totals[label] / (labels == label).sum() for label in (0, 1)}
    model.weights = np.array([stands[label] for label in labels.tolist()])
    return model


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [row.tobytes() for row in term_shares(batch.column("text"))]
        columns = [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "shares"])


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", texts: int = TRAIN_TEXTS) -> Model:
    """Fit on ``doc_id, text`` and ``doc_id`` with 1 or 0 in column ``label``: at most ``texts`` texts of each class."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    ids = documents.where("text IS NOT NULL").select("doc_id").distinct().join(known, "doc_id")
    ids = stage(ids.withColumn("draw", F.abs(F.xxhash64("doc_id") % F.lit(1_000_000))), "labelled")
    totals = {r.label: r.n for r in ids.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for k, total in totals.items():
        # A little more than are asked for fall below this draw; the rest need not be sorted.
        below = 1_000_000 * min(1.0, 1.5 * texts / total + 1e-4)
        part = ids.where((F.col("label") == k) & (F.col("draw") <= below))
        parts.append(part.orderBy("draw", "doc_id").limit(texts).select("doc_id", "label"))
    if not parts:
        return Model(0.5)
    drawn = stage(parts[0].unionByName(parts[-1]) if len(parts) > 1 else parts[0], "drawn")  # 2 * texts rows at most
    sample = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id")
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    with arrow_rows(documents.sparkSession, TEXT_ROWS):
        sample = stage(sample.mapInArrow(_shares, "doc_id bigint, label int, shares binary"), "sample")
        rows = sorted((r.label, r.doc_id, bytes(r.shares)) for r in sample.collect())
    found = np.frombuffer(b"".join(shares for *_, shares in rows), np.float32).reshape(-1, FEATURES)
    return fit(np.array([label for label, *_ in rows]), found, totals)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.score(term_shares(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every document, staged."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2 * TRAIN_TEXTS vectors, and the axes
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(spark, TEXT_ROWS):
        return stage(texts.mapInArrow(_scored(shared), "doc_id bigint, score double"), "votes")
