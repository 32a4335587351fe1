"""Toxicity: a support vector machine on a subsequence string kernel, with Nystrom landmarks.

Words are compared by the gap-weighted subsequence kernel: the common subsequences
of ``P`` letters, each weighted by ``DECAY`` to the power of the length it spans in
either word, so an insult with letters inserted or dots between still resembles it.
Words set letter by letter ("i d i o t") are read as one.

A sentence's similarity to a landmark is that of its most similar word. Landmarks are
words, and word beginnings, that tell toxic from clean training texts apart. The
Nystrom map turns the similarities into coordinates whose inner products approximate
the kernel, where linear machines with squared hinge loss are trained on labelled
sentences: all of clean texts, and of each toxic text those that the last round's
machine found bad, the worst one in any case. One machine sees similarities of at
least ``LARGE`` only. The other sees all of them and learns the toxic sentences once
more with ``INSERTED`` letters inserted in the words like a landmark, so that small
similarities get their weight. A text's score is the mean of both machines'
probabilities (fitted sigmoids) of its worst sentence. Words of fewer than ``P``
letters are like nothing.

The model learns from at most ``TRAIN_TEXTS`` labelled texts of each class, those with
the least hash of their id, with at most ``SENTENCES`` sentences of each; word counts
and kernels are computed on the executors, and only landmarks and the vectors of the
sampled sentences reach the driver. Scoring is one pass over whole texts, without a
shuffle; each task keeps the kernels of up to ``KNOWN_WORDS`` words it met.

Edge cases: a null or empty text has one empty sentence, similar to nothing. A row
without a label is scored, not learned from; repeated labels of an id count as toxic
if any is. Repeated rows are scored each. Without toxic or without clean training
texts every score is the share of toxic ones (0 if there are none). An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwise.llm.common import arrow_rows
from stallwise.sources.staging import stage

P = 4
DECAY = 0.85
LEAST = 0.12  # similarities below count as none; an insult with two letters inserted has 0.2 or more
LARGE = 0.4  # similarities from here on have a coordinate of their own beside that of all
ALIKE, INSERTED = 0.75, 2  # training words so like a landmark are learned from with so many letters inserted, too
LONGEST = 24  # letters of a word that are compared at once; longer words are cut into overlapping parts
START = 5  # letters of a word's beginning
LANDMARKS = 40
TRAIN_TEXTS = 3000  # of each class
SENTENCES = 40  # of each training text
KNOWN_WORDS = 300_000
TEXT_ROWS = 512
THRESHOLD = 0.7

_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)")
_SPELLED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\W_]{1,2}){3,}[^\W\d_](?![^\W_])")
_NOT_LETTER = re.compile(r"[\W_]+")
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def units(text: str) -> set[str]:
    """The words of a text in lower case, and those set letter by letter."""
    found = set(text.split())
    for spelled in _SPELLED.findall(text):
        found.add(_NOT_LETTER.sub("", spelled))
    return found


def _codes(words: list[str], width: int) -> np.ndarray:
    """Words as rows of code points, padded with 0."""
    padded = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(padded.encode("utf-32-le"), np.uint32).reshape(len(words), width)


def _subsequences(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernel of each pair of rows of code points (0 pads), by the usual recursion over both words."""
    n, width = s.shape
    m = t.shape[1]
    ahead = [np.ones((n, m + 1), np.float32)] + [np.zeros((n, m + 1), np.float32) for _ in range(P - 1)]
    total = np.zeros(n, np.float32)
    square = np.float32(DECAY * DECAY)
    decay = np.float32(DECAY)
    for i in range(width):
        letter = s[:, i : i + 1]
        same = (letter == t) & (letter != 0)
        total += square * (same * ahead[P - 1][:, :-1]).sum(axis=1)
        for level in range(P - 1, 0, -1):
            # The lower level still holds the values of the word without this letter.
            gain = square * same * ahead[level - 1][:, :-1]
            row = np.zeros((n, m + 1), np.float32)
            for j in range(m):
                row[:, j + 1] = decay * row[:, j] + gain[:, j]
            ahead[level] = decay * ahead[level] + row
    return total


@dataclass
class Landmarks:
    words: list[str]
    rows: np.ndarray = field(init=False)
    norms: np.ndarray = field(init=False)
    letters: np.ndarray = field(init=False)
    places: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.rows = _codes(self.words, max(map(len, self.words), default=1))
        self.norms = np.sqrt(np.maximum(_subsequences(self.rows, self.rows), 1e-12))
        self.letters = np.unique(self.rows[self.rows > 0])
        # For each letter (and one entry for any other) the bit set of its places in each landmark.
        bit = np.uint64(1) << np.arange(self.rows.shape[1], dtype=np.uint64)
        found = [((self.rows == letter) * bit).sum(axis=1, dtype=np.uint64) for letter in self.letters]
        self.places = np.array([*found, np.zeros(len(self.words), np.uint64)], np.uint64)

    def similarities(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each word with each landmark, 0 below ``LEAST``."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        parts, owner = [], []
        if not self.words:
            return out
        for k, word in enumerate(words):
            word = word.strip(_EDGE)
            if not word.isalnum():  # set apart by hyphens, dots and the like
                word = _NOT_LETTER.sub("", word)
            if len(word) >= P:
                for start in range(0, max(1, len(word) - LONGEST // 2), LONGEST // 2):
                    parts.append(word[start : start + LONGEST])
                    owner.append(k)
        order = np.argsort([len(p) for p in parts], kind="stable")
        owner = np.array(owner, np.int64)
        for start in range(0, len(order), 4000):
            chunk = order[start : start + 4000]
            rows = _codes([parts[k] for k in chunk], len(parts[chunk[-1]]))
            pairs = np.argwhere(self._common(rows) >= P)
            if not len(pairs):
                continue
            used, place = np.unique(pairs[:, 0], return_inverse=True)
            own = np.sqrt(np.maximum(_subsequences(rows[used], rows[used]), 1e-12))
            value = _subsequences(rows[pairs[:, 0]], self.rows[pairs[:, 1]])
            value = value / (own[place] * self.norms[pairs[:, 1]])
            np.maximum.at(out, (owner[chunk][pairs[:, 0]], pairs[:, 1]), np.where(value >= LEAST, value, 0))
        return out

    def _common(self, rows: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of each word with each landmark, by bit arithmetic."""
        at = np.minimum(np.searchsorted(self.letters, rows), len(self.letters) - 1)
        at = np.where(self.letters[at] == rows, at, len(self.letters))
        state = np.full((len(rows), len(self.words)), 2**64 - 1, np.uint64)
        for i in range(rows.shape[1]):
            here = state & self.places[at[:, i]]
            state = (state + here) | (state - here)
        inside = (np.uint64(1) << np.uint64(self.rows.shape[1])) - np.uint64(1)
        return np.bitwise_count(~state & inside)


class Similar:
    """Kernel vectors of words, remembered; words similar to no landmark are None."""

    def __init__(self, landmarks: Landmarks) -> None:
        self.landmarks, self.known = landmarks, {}

    def learn(self, words: set[str]) -> None:
        """Make all these words known; older ones are forgotten when there are too many."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = words
        ordered = list(new)
        rows = self.landmarks.similarities(ordered)
        self.known.update(dict.fromkeys(ordered))
        for k in np.flatnonzero(rows.any(axis=1)):
            self.known[ordered[k]] = rows[k].copy()

    def sentences(self, text: str, found: set[str]) -> np.ndarray:
        """A row for each sentence with a word like a landmark; one of zeros if there is none."""
        like = {w for w in found if self.known[w] is not None}
        if not like:
            return np.zeros((1, len(self.landmarks.words)), np.float32)
        rows = []
        for sentence in _SENTENCE.split(text):
            near = [self.known[w] for w in units(sentence) if w in like]
            if near:
                rows.append(np.max(near, axis=0))
        # A word that a sentence bound cuts belongs to the text as a whole.
        return np.array(rows or [np.max([self.known[w] for w in like], axis=0)])


def _sentence_rows(texts: list[str | None], similar: Similar) -> Iterator[np.ndarray]:
    texts = [(text or "").lower() for text in texts]
    found = [units(text) for text in texts]
    similar.learn(set().union(*found))
    for text, words in zip(texts, found):
        yield similar.sentences(text, words)


def inserted(word: str) -> str:
    """A word in lower case with ``INSERTED`` letters inside, always the same ones; shorter than ``P`` as it is."""
    core = word.strip(_EDGE)
    if len(core) < P:
        return word
    draw, letters = random.Random(core), list(core)
    for place in sorted(draw.sample(range(1, len(core)), INSERTED), reverse=True):
        letters.insert(place, draw.choice(ascii_lowercase))
    return "".join(letters)


def _inserted_rows(text: str | None, similar: Similar) -> np.ndarray:
    """A row for each sentence with words like a landmark, as if these had letters inserted. All words are known already."""
    rows = []
    for sentence in _SENTENCE.split((text or "").lower()):
        near = {w: similar.known[w] for w in units(sentence) if similar.known.get(w) is not None}
        alike = [w for w, row in near.items() if row.max() >= ALIKE]
        if alike:
            others = [row for w, row in near.items() if w not in alike]
            rows.append(np.max([*similar.landmarks.similarities([inserted(w) for w in alike]), *others], axis=0))
    return np.array(rows, np.float32).reshape(-1, len(similar.landmarks.words))


def large(rows: np.ndarray) -> np.ndarray:
    """The similarities of at least ``LARGE``, in the rows that have one; a row of zeros if none has."""
    kept = rows[(rows >= LARGE).any(axis=1)]
    return np.where(kept >= LARGE, kept, 0) if len(kept) else np.zeros((1, rows.shape[1]))


def coordinates(rows: np.ndarray) -> np.ndarray:
    """All similarities and, after them, those of at least ``LARGE``, so small ones are weighed apart from large ones."""
    return np.hstack([rows, np.where(rows >= LARGE, rows, 0)])


@dataclass
class Machine:
    weights: np.ndarray  # the Nystrom map and the machine in one
    bias: float
    slope: float
    offset: float

    def score(self, rows: np.ndarray) -> float:
        worst = float((rows @ self.weights + self.bias).max())
        return float(1 / (1 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30))))


@dataclass
class Model:
    landmarks: list[str]
    plain: Machine | None = None  # on large similarities
    gapped: Machine | None = None  # on coordinates of all
    constant: float | None = None

    def score(self, rows: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return (self.plain.score(large(rows)) + self.gapped.score(coordinates(rows))) / 2


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        margin = 1 - y * (x @ w)
        on = margin > 0
        gradient = keep @ w - x[on].T @ (cost[on] * y[on] * margin[on])
        step = np.linalg.solve(keep + (x[on] * cost[on, None]).T @ x[on], gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sigmoid(values: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton steps on smoothed targets."""
    ones, zeros = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([values, np.ones(len(values))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _fit(grams: list[np.ndarray], texts: list[tuple[int, np.ndarray]], first: list[np.ndarray], rounds: int) -> Machine:
    """A machine on coordinates with these kernels of the landmarks. ``first``: the toxic texts' sentences taken for bad."""
    whitened = np.zeros((sum(map(len, grams)),) * 2)
    at = 0
    for gram in grams:
        value, vector = np.linalg.eigh((gram + gram.T) / 2)
        block = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T  # K_mm ** -1/2
        whitened[at : at + len(gram), at : at + len(gram)] = block
        at += len(gram)
    clean = np.vstack([rows for label, rows in texts if label == 0]) @ whitened
    gapped = np.vstack([np.zeros((0, len(whitened))), *(rows for label, rows in texts if label == 2)]) @ whitened
    toxic = [rows @ whitened for label, rows in texts if label == 1]
    w, bad = None, first
    for _ in range(rounds):
        for rows, chosen in zip(toxic, bad):
            chosen[(rows @ w[:-1]).argmax() if w is not None else np.linalg.norm(rows, axis=1).argmax()] = True
        worst = np.vstack([gapped, *(rows[chosen] for rows, chosen in zip(toxic, bad))])
        x, y = np.vstack([worst, clean]), np.array([1.0] * len(worst) + [-1.0] * len(clean))
        w = _machine(x, y, np.where(y > 0, 10.0, 10.0 * len(worst) / max(len(clean), 1)))
        bad = [rows @ w[:-1] + w[-1] > 0 for rows in toxic]
    weights, bias = whitened @ w[:-1], float(w[-1])
    whole = [(label, rows) for label, rows in texts if label < 2]
    values = np.array([(rows @ weights + bias).max() for _, rows in whole])
    slope, offset = _sigmoid(values, np.array([label for label, _ in whole]) * 2 - 1)
    return Machine(weights, bias, slope, offset)


def fit(landmarks: list[str], texts: list[tuple[int, np.ndarray]], rounds: int = 4) -> Model:
    """The model of labelled texts, given as (label, rows of sentence similarities).

    Rows of label 2 are toxic sentences with letters inserted; no probability is fitted on them.
    """
    gram = Landmarks(landmarks).similarities(landmarks).astype(float)
    strong = np.where(gram >= LARGE, gram, 0)
    # At first every sentence with a word like a landmark is taken for bad.
    like = [(rows >= LARGE).any(axis=1) for label, rows in texts if label == 1]
    plain = [(label, large(rows)) for label, rows in texts if label < 2]
    first = [rows.any(axis=1) for label, rows in plain if label == 1]
    every = [(label, coordinates(rows)) for label, rows in texts]
    return Model(landmarks, _fit([strong], plain, first, rounds), _fit([gram, strong], every, like, rounds))


def _drawn(documents: DataFrame, labels: DataFrame, texts: int) -> DataFrame:
    """Staged ``doc_id, toxic, text``: the sample that is learned from. Only ids meet the labels; texts aren't shuffled."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
    known = known.agg(F.max("toxic").cast("int").alias("toxic"))
    ids = documents.select("doc_id").distinct().join(known, "doc_id")
    parts = [ids.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts) for k in (0, 1)]
    ids = stage(parts[0].unionByName(parts[1]), "drawn")  # 2 * texts rows at most
    return stage(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), "sample")


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text and their beginnings."""
    for batch in batches:
        rows = []
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            words = {w.strip(_EDGE) for w in units((text or "").lower())}
            rows += [(toxic, w) for w in words | {w[:START] for w in words} if P <= len(w) <= LONGEST]
        columns = list(zip(*rows)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string())], ["toxic", "word"])


def choose_landmarks(sample: DataFrame, landmarks: int = LANDMARKS) -> list[str]:
    """Words and beginnings that tell toxic texts from clean ones, none too like another."""
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    counts = sample.select("toxic", "text").mapInArrow(_starts, "toxic int, word string").groupBy("word")
    counts = counts.agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    expected = F.col("b") * F.lit(sizes[1] / sizes[0])
    contrast = ((F.col("a") - expected) / F.sqrt(expected + F.lit(1.0))).alias("contrast")
    best = counts.where("a >= 3").select("word", contrast).orderBy(F.desc("contrast"), F.length("word"), "word")
    chosen: list[str] = []
    for row in best.limit(20 * landmarks).collect():
        if row.contrast < 2 or len(chosen) >= landmarks:
            break
        if not chosen or Landmarks(chosen).similarities([row.word]).max() < 0.75:
            chosen.append(row.word)
    return chosen


def _vectors(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        similar = Similar(Landmarks(shared.value))
        for batch in batches:
            kinds, out = [], []
            texts, labels = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            for text, toxic, rows in zip(texts, labels, _sentence_rows(texts, similar)):
                for kind, found in ((toxic, rows), (2, _inserted_rows(text, similar) if toxic else rows[:0])):
                    if len(found):
                        largest = np.argsort(-np.linalg.norm(found, axis=1), kind="stable")[:SENTENCES]
                        kinds.append(kind)
                        out.append(found[largest].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(out, pa.binary())], ["toxic", "rows"])

    return run


def train(documents: DataFrame, labels: DataFrame, texts: int = TRAIN_TEXTS, landmarks: int = LANDMARKS) -> Model:
    """Fit on ``doc_id, text`` and ``doc_id, toxic`` (1 or 0): at most ``texts`` of each class."""
    spark = documents.sparkSession
    with arrow_rows(spark, TEXT_ROWS):
        sample = _drawn(documents, labels, texts)
        marks = choose_landmarks(sample, landmarks)
        if not marks:
            sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
            share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
            return Model([], constant=share)
        shared = spark.sparkContext.broadcast(marks)
        rows = stage(sample.select("toxic", "text").mapInArrow(_vectors(shared), "toxic int, rows binary"), "vectors")
        found = sorted((r.toxic, bytes(r.rows)) for r in rows.collect())
    width = len(marks)
    return fit(marks, [(label, np.frombuffer(b, np.float32).reshape(-1, width).astype(float)) for label, b in found])


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        similar = Similar(Landmarks(model.landmarks))
        for batch in batches:
            scores = [model.score(rows) for rows in _sentence_rows(batch.column("text").to_pylist(), similar)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every document, staged."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)  # landmarks and as many weights
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(spark, TEXT_ROWS):
        return stage(texts.mapInArrow(_scored(shared), "doc_id bigint, score double"), "toxicity")
