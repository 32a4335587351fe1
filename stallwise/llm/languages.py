"""Language identification by nearest centroid.

A text becomes a vector of hashed character n-grams (one to three characters of the
lower-cased letters, words set off by a blank), weighted by log(1 + count) times
inverse document frequency and normalised. Every language has several centroids,
found by spherical k-means among its training texts, and a text takes the language
of the centroid with the largest cosine. A text whose cosine lies below what all
but a few of that language's training texts reach is marked as rejected; it still
names its nearest language. The score is the share of the chosen language among the
best cosines of all languages (a softmax).

The model is fitted on at most ``TRAIN_ROWS`` texts of each language, those with
the least hash of their id, reduced to vectors on the executors; only these vectors
(``TRAIN_ROWS`` x ``FEATURES`` numbers a language) reach the driver. Scoring is one
pass over whole texts in tasks, in batches of bounded size, without a shuffle.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. Ties of
cosines go to the language first in code-point order. Repeated rows are scored
each and may be drawn into the sample each. Null languages and empty texts are not
learned. Without any training text every text is ``und``. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwise.llm.common import arrow_rows
from stallwise.llm.shingles import mix
from stallwise.sources.staging import stage

FEATURES = 4096
ORDERS = (1, 2, 3)
TRAIN_ROWS = 600  # of each language
CENTROIDS = 4  # of each language
ROUNDS = 12
SHARPNESS = 12.0
REJECTED_SHARE = 0.002  # of a language's training texts that lie farther than its limit
CHUNK_CHARS = 200_000
TEXT_ROWS = 512
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def gram_counts(text: str) -> np.ndarray:
    """Hashed counts of a text's character n-grams, taken over chunks of bounded size.

    A chunk begins with the last characters of the one before, and counts n-grams that end in its own.
    """
    counts = np.zeros(FEATURES, np.float32)
    text, carried = text.lower(), np.array([], np.uint64)
    for start in range(0, max(len(text), 1), CHUNK_CHARS):
        part = text[start : start + CHUNK_CHARS]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = (points >= 97) & (points <= 122) | (points >= 0xAA)
        points = np.where(letters, points, 32).astype(np.uint64)
        ends = [[32]] if start + CHUNK_CHARS >= len(text) else []
        points = np.concatenate([carried if start else [32], points, *ends]).astype(np.uint64)
        blank = points == 32
        points = points[~(blank & np.concatenate(([False], blank[:-1])))]  # runs of others are one blank
        grams = np.zeros(len(points), np.uint64)
        for order in ORDERS:
            grams = grams[: len(points) - order + 1] * np.uint64(0x100000001B3) + points[order - 1 :]
            own = grams[max(0, len(carried) - order + 1) :]
            slot = (mix(own, order) % np.uint64(FEATURES)).astype(np.int64)
            counts += np.bincount(slot, minlength=FEATURES).astype(np.float32)
        carried = points[-(max(ORDERS) - 1) :]
    return counts


@dataclass
class Model:
    languages: list[str]  # in code-point order
    idf: np.ndarray  # FEATURES
    centroids: np.ndarray  # all centroids x FEATURES
    owner: np.ndarray  # language of each centroid
    limit: np.ndarray  # least cosine of each language

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score and rejection of each row of counts."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = np.stack([cosines[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
        chosen = best.argmax(axis=1)
        top = best[np.arange(len(best)), chosen]
        share = np.exp(SHARPNESS * (best - top[:, None])).sum(axis=1)
        return chosen, 1.0 / share, top < self.limit[chosen]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _clustered(rows: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; the first centres are far from each other, so the result is repeatable."""
    centres = [_unit(rows.mean(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(rows)):
        nearest = (rows @ np.array(centres).T).max(axis=1)
        centres.append(rows[nearest.argmin()])
    centres = np.array(centres)
    for _ in range(ROUNDS):
        member = (rows @ centres.T).argmax(axis=1)
        sums = [rows[member == c].sum(axis=0) if (member == c).any() else centres[c] for c in range(len(centres))]
        centres = _unit(np.array(sums))
    return centres


def fit(rows: list[tuple[str, np.ndarray]], centroids: int = CENTROIDS) -> Model | None:
    """The model of labelled count vectors."""
    if not rows:
        return None
    languages = sorted({language for language, _ in rows})
    counts = np.stack([row for _, row in rows])
    label = np.array([languages.index(language) for language, _ in rows])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    model = Model(languages, idf, np.empty((0, FEATURES)), np.empty(0, int), np.zeros(len(languages)))
    vectors = model.vectors(counts)
    for k in range(len(languages)):
        centres = _clustered(vectors[label == k], centroids)
        model.centroids = np.concatenate([model.centroids, centres]).astype(np.float32)
        model.owner = np.concatenate([model.owner, np.full(len(centres), k)])
        near = (vectors[label == k] @ centres.T).max(axis=1)
        model.limit[k] = np.quantile(near, REJECTED_SHARE) * 0.5
    return model


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [gram_counts(text).astype(np.float32).tobytes() for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(rows, pa.binary())], ["lang", "counts"])


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, centroids: int = CENTROIDS) -> Model | None:
    """Fit on ``doc_id, text, lang``: at most ``rows`` texts of each language."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    # The rank is taken over keys alone, and over those only whose hash is among a language's least by its number of
    # texts, with room to spare; texts are fetched for the rows drawn.
    keys = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("draw"))
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("texts")).withColumnRenamed("lang", "of")
    part = F.col("draw") / F.lit(2.0**64) + F.lit(0.5)
    near = keys.join(sizes, F.col("lang") == F.col("of")).where(part <= F.lit(2.0 * rows + 100) / F.col("texts"))
    turn = F.row_number().over(W.partitionBy("lang").orderBy("draw", "doc_id"))
    keys = near.withColumn("turn", turn).where(F.col("turn") <= rows)
    keys = stage(keys.select("doc_id").distinct(), "drawn")
    texts = known.join(F.broadcast(keys), known["doc_id"].eqNullSafe(keys["doc_id"]), "left_semi").select("lang", "text")
    with arrow_rows(labelled.sparkSession, TEXT_ROWS):
        sample = stage(texts.mapInArrow(_counted, "lang string, counts binary"), "sample").collect()
    drawn_rows = sorted((r.lang, bytes(r.counts)) for r in sample)
    return fit([(lang, np.frombuffer(counts, np.float32)) for lang, counts in drawn_rows], centroids)


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = [i for i, text in enumerate(texts) if model and text and _LETTER.search(text)]
            language, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
            for start in range(0, len(known), 128):
                part = known[start : start + 128]
                chosen, share, far = model.predict(np.stack([gram_counts(texts[i]) for i in part]))
                for i, k, s, out in zip(part, chosen, share, far):
                    language[i], score[i], rejected[i] = model.languages[k], float(s), bool(out)
            columns = [batch.column("doc_id"), pa.array(language), pa.array(score, pa.float64()), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    return run


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every document, staged."""
    spark: SparkSession = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x centroids x FEATURES numbers
    schema = "doc_id bigint, lang_pred string, score double, rejected boolean"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(spark, TEXT_ROWS):
        return stage(texts.mapInArrow(_predicted(shared), schema), "languages")
