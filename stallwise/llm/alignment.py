"""Cross-tokenizer alignment: which tokens of one vocabulary cover which of another.

Every text is tokenised whole by a byte-level BPE (A: a space and the text) and by
a piece BPE (B: the text; it adds the space itself), without special tokens. Both
must spell the same bytes; then:

* A byte offset at which a token of A and one of B end together, and after which both
  go on with a token that begins with a space, is an anchor. Anchors cut the document
  into windows of a word or so.
* A window is known by its two tuples of token ids: its groups (runs between shared
  ends) and links (pairs of overlapping tokens) follow from them alone, since ids fix
  the bytes. So each distinct window is aligned once in a task and looked up after.
* A pair's count is the number of documents that hold it linked. Documents are
  staged with their distinct pairs, which Spark counts over the corpus. Best pairs are
  those with the highest count of their A token.
* Each document's links are then weighed by those counts. The table of counts is cut
  into slices of whole A tokens, at most ``SLICE`` pairs and one token's pairs each; a
  slice at a time is broadcast to a pass over the staged pairs, and the partial sums of
  a document are added up. So the largest thing sent anywhere is one slice, and
  nothing is shuffled but counts and, with several slices, sums.

Memory: a batch has ``TEXT_ROWS`` texts, whatever their length; known windows are
forgotten beyond ``WINDOWS`` of them, or eight times as many links.

Edge cases: null and empty texts, and those whose tokens of either side don't spell
space and text (a U+2581 in the text becomes a space, for one), have no tokens: zeros
and an empty ``groups``. Texts of any length are aligned whole. Repeated rows, and rows
without an id, are documents of their own and count each. Ties for the best
pair are all best. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache, reduce
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm.common import arrow_rows
from stallwise.sources.staging import stage

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# A space in the piece vocabulary, and the word pattern of byte-level vocabularies.
SPACE_MARK = "▁"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 4_000_000  # pairs broadcast at a time: 12 bytes each
WINDOWS = 200_000  # known windows of a task: about 60 MB
TEXT_ROWS = 128
PIECE_BITS = 15  # of a pair's number hold the B id; the A id is above


class Tokens(NamedTuple):
    """What is known of a vocabulary's ids."""

    spelled: list[bytes]
    length: np.ndarray
    spaced: np.ndarray  # begins with a space

    @classmethod
    def of(cls, spelled: list[bytes]) -> Tokens:
        return cls(spelled, np.array([len(s) for s in spelled]), np.array([s.startswith(b" ") for s in spelled]))


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Both tokenizers, read from their files' contents."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        import sentencepiece
        import tiktoken

        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        ranks = _ranks(json.loads(byte_file))
        # Ids that follow the merges are ranks, which this encoder works by; special tokens aren't among them.
        self.a = tiktoken.Encoding("bytes", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = Tokens.of(sorted(ranks, key=ranks.__getitem__))
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = Tokens.of(
            [
                bytes([int(piece[3:-1], 16)]) if self.b.is_byte(k) else piece.replace(SPACE_MARK, " ").encode()
                for k, piece in enumerate(pieces)
            ]
        )
        if len(self.bytes_b.spelled) > 1 << PIECE_BITS or len(self.bytes_a.spelled) > 1 << 31 - PIECE_BITS:
            raise ValueError("a pair of ids must fit 31 bits")

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of A and B of each text; empty where they don't spell a space and the text."""
        for text, ids_b in zip(texts, self.b.encode(texts, num_threads=1)):
            ids_a = self.a.encode_ordinary(" " + text)
            whole = (" " + text).encode()
            same = b"".join(map(self.bytes_a.spelled.__getitem__, ids_a)) == whole
            if text and same and b"".join(map(self.bytes_b.spelled.__getitem__, ids_b)) == whole:
                yield ids_a, ids_b
            else:
                yield [], []


def _ranks(file: dict) -> dict[bytes, int]:
    """Tokens of a byte-level BPE file as bytes, with their ids, which must be places in the order of merges."""
    letters, model = byte_letters(), file["model"]
    special = {token["content"] for token in file["added_tokens"]}
    ranks = {
        bytes(letters[c] for c in token): k for token, k in model["vocab"].items() if token not in special
    }
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    order = [ranks[bytes(letters[c] for c in token)] for token in merged]
    if sorted(ranks.values()) != list(range(len(ranks))) or order != list(range(256, len(ranks))):
        raise ValueError("the ids of a byte vocabulary must be its bytes and then its merges in their order")
    if file["normalizer"] or file["pre_tokenizer"].get("add_prefix_space") or not file["pre_tokenizer"]["use_regex"]:
        raise ValueError("a byte vocabulary must split plain text by the usual word pattern")
    return ranks


@cache
def _pair(byte_file: bytes, piece_file: bytes) -> Pair:
    return Pair(byte_file, piece_file)


class Documents(NamedTuple):
    """Alignments of a batch: numbers by document, and every document's windows and links."""

    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]  # ids of A and B of each group, of the whole document
    pairs: list[np.ndarray]  # distinct links: A id above B id
    times: list[np.ndarray]  # how often each occurs


class Aligner:
    """Alignments of documents, with the windows met so far, by their tuples of ids."""

    def __init__(self, pair: Pair, windows: int = WINDOWS):
        self.a, self.b, self.limit = pair.bytes_a, pair.bytes_b, windows
        # An id as text behind what may come before it: nothing, a new group, its group's other ids; A's ids, other ids.
        self.text_a = np.array([[f"{mark}{k}" for k in range(len(self.a.spelled))] for mark in ("", ";", ",")], object)
        self.text_b = np.array([[f"{mark}{k}" for k in range(len(self.b.spelled))] for mark in ("|", ",")], object)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # packed ids of a window -> its number
        self.groups: list[str] = []  # by number
        self.links = np.empty(0, np.int64)  # of all windows; by number:
        self.first, self.n_links, self.n_groups = (np.empty(0, np.int64) for _ in range(3))

    def align(self, documents: list[tuple[list[int], list[int]]]) -> Documents:
        """Align documents whose two sides spell the same bytes."""
        if len(self.known) > self.limit or len(self.links) > 8 * self.limit:
            self._forget()
        ids_a, ids_b = (np.concatenate([np.array(d[k], np.int64) for d in documents]) for k in (0, 1))
        sizes = np.array([[len(a), len(b)] for a, b in documents], np.int64).reshape(-1, 2)
        cuts_a, cuts_b = self._anchors(ids_a, ids_b, sizes)
        number = self._numbers(ids_a, ids_b, cuts_a, cuts_b)
        # Windows don't reach over documents: each begins with one.
        first = np.searchsorted(cuts_a[:-1], np.concatenate(([0], np.cumsum(sizes[:, 0]))))
        owner = np.repeat(np.arange(len(documents)), np.diff(first))
        counts = self.n_links[number]
        place = np.repeat(self.first[number] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        links, times = np.unique(np.repeat(owner, counts) << 31 | self.links[place], return_counts=True)
        ends = np.searchsorted(links, np.arange(len(documents) + 1) << 31)
        links &= (1 << 31) - 1
        spelled = list(map(self.groups.__getitem__, number.tolist()))
        return Documents(
            np.bincount(owner, self.n_groups[number], len(documents)).astype(np.int64),
            np.bincount(owner, counts, len(documents)).astype(np.int64),
            [";".join(spelled[i:k]) for i, k in zip(first.tolist(), first[1:].tolist())],
            [links[i:k] for i, k in zip(ends, ends[1:])],
            [times[i:k] for i, k in zip(ends, ends[1:])],
        )

    def _anchors(self, ids_a: np.ndarray, ids_b: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First token of A and of B of each window, and behind the last: shared ends that both go on from with a space."""
        length_a, length_b = self.a.length[ids_a], self.b.length[ids_b]
        starts_a, starts_b = np.cumsum(length_a) - length_a, np.cumsum(length_b) - length_b
        marked = np.zeros(int(length_a.sum()) + 1, bool)
        marked[starts_a[self.a.spaced[ids_a]]] = True
        begins = np.cumsum(sizes[:, 1]) - sizes[:, 1]  # documents' first tokens, shared starts in any case
        begins = begins[sizes[:, 1] > 0]
        shared = self.b.spaced[ids_b] & marked[starts_b]
        shared[begins] = True
        cuts_b = np.flatnonzero(shared)
        cuts_a = np.searchsorted(starts_a, starts_b[cuts_b])
        return np.append(cuts_a, len(ids_a)), np.append(cuts_b, len(ids_b))

    def _numbers(self, ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> np.ndarray:
        """The number of each window among those known; new ones are aligned."""
        windows = len(cuts_a) - 1
        packed = np.empty(len(ids_a) + len(ids_b), np.int32)  # A's ids, marked, then B's, window by window
        before_b, before_a = np.repeat(cuts_b[:-1], np.diff(cuts_a)), np.repeat(cuts_a[1:], np.diff(cuts_b))
        packed[np.arange(len(ids_a)) + before_b] = ids_a | 1 << 30
        packed[np.arange(len(ids_b)) + before_a] = ids_b
        data, ends = packed.tobytes(), ((cuts_a + cuts_b) * 4).tolist()
        keys = [data[i:k] for i, k in zip(ends, ends[1:])]
        number = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, windows)
        fresh = []
        for w in np.flatnonzero(number < 0).tolist():
            found = self.known.setdefault(keys[w], len(self.known))
            if found == len(self.groups) + len(fresh):
                fresh.append(w)
            number[w] = found
        if fresh:
            self._learn(ids_a, ids_b, cuts_a, cuts_b, np.array(fresh))
        return number

    def _learn(self, ids_a, ids_b, cuts_a, cuts_b, fresh: np.ndarray) -> None:
        """Align new windows, one behind the other: every stretch between ends of either side is a link."""

        def joined(ids: np.ndarray, cuts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
            n = cuts[fresh + 1] - cuts[fresh]
            at = np.repeat(cuts[fresh] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            return ids[at], np.cumsum(length[ids[at]]), np.repeat(np.arange(len(fresh)), n)

        a, ends_a, window = joined(ids_a, cuts_a, self.a.length)
        b, ends_b, _ = joined(ids_b, cuts_b, self.b.length)
        starts = np.concatenate(([0], np.union1d(ends_a, ends_b)[:-1]))
        in_a, in_b = np.searchsorted(ends_a, starts, "right"), np.searchsorted(ends_b, starts, "right")
        counts = np.bincount(window[in_a], minlength=len(fresh))
        shared, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        n_groups = np.bincount(window[last_a], minlength=len(fresh))

        # Tokens in the order of the text: A's of a group, then B's, each behind its separator.
        group_a, group_b = np.searchsorted(ends_a[last_a], ends_a), np.searchsorted(ends_a[last_a], ends_b)
        text = np.empty(len(a) + len(b), object)
        begins_a, begins_b = np.append(True, group_a[1:] != group_a[:-1]), np.append(True, group_b[1:] != group_b[:-1])
        opens = np.append(True, window[1:] != window[:-1])
        mark_a = np.where(opens, 0, np.where(begins_a, 1, 2))
        text[np.arange(len(a)) + np.append(0, last_b + 1)[group_a]] = self.text_a[mark_a, a]
        text[np.arange(len(b)) + (last_a + 1)[group_b]] = self.text_b[np.where(begins_b, 0, 1), b]
        starts_of = np.flatnonzero(opens)
        ends = [*(starts_of + np.append(0, last_b + 1)[group_a[starts_of]]).tolist(), len(text)]
        text = text.tolist()
        self.groups += ["".join(text[i:k]) for i, k in zip(ends, ends[1:])]
        self.first = np.concatenate([self.first, len(self.links) + np.cumsum(counts) - counts])
        self.links = np.concatenate([self.links, a[in_a] << PIECE_BITS | b[in_b]])
        self.n_links, self.n_groups = np.append(self.n_links, counts), np.append(self.n_groups, n_groups)


_ALIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("groups", pa.string()),
        ("pairs", pa.list_(pa.int32())),
        ("times", pa.list_(pa.int32())),
    ]
)


def _aligned(files, spelled: bool):
    """A row per document: sizes, its groups as text or their digest, and its distinct pairs with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files.value)
        aligner = Aligner(pair)
        for batch in batches:
            tokens = list(pair.encode([text or "" for text in batch.column("text").to_pylist()]))
            found = aligner.align(tokens)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups]
            ends = pa.array(np.cumsum([0, *map(len, found.pairs)]), pa.int32())
            pairs, times = (pa.array(np.concatenate(x), pa.int32()) for x in (found.pairs, found.times))
            columns = [
                batch.column("doc_id"),
                *(pa.array([len(ids[k]) for ids in tokens], pa.int64()) for k in (0, 1)),
                pa.array(found.n_groups),
                pa.array(found.n_links),
                pa.array(digests, pa.string()),
                pa.array(found.groups if spelled else [None] * len(digests), pa.string()),
                pa.ListArray.from_arrays(ends, pairs),
                pa.ListArray.from_arrays(ends, times),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_ALIGNED)

    return run


def align_documents(
    documents: DataFrame,
    byte_vocabulary: str = BYTE_VOCABULARY,
    piece_vocabulary: str = PIECE_VOCABULARY,
    spelled: bool = False,
) -> DataFrame:
    """Staged: ``row`` (unique), ``doc_id``, sizes, ``groups_sha256``, ``groups`` if asked for, ``pairs`` and ``times``."""
    spark: SparkSession = documents.sparkSession
    contents = []
    for file in (byte_vocabulary, piece_vocabulary):
        with open(file, "rb") as opened:
            contents.append(opened.read())
    files = spark.sparkContext.broadcast(tuple(contents))  # two vocabulary files: 2 MB
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = (
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string,"
        " pairs array<int>, times array<int>"
    )
    with arrow_rows(spark, TEXT_ROWS):
        found = texts.mapInArrow(_aligned(files, spelled), schema)
        return stage(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Staged: ``pair, a, n, best``: documents that hold a pair, and 1 where no other pair of its A token has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.withColumn("a", F.shiftright("pair", PIECE_BITS)), "pairs")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    best = (F.col("n") == F.col("most")).cast("long").alias("best")
    return stage(counts.join(most, "a").select("pair", "a", "n", best), "counts")


def _slices(counts: DataFrame, limit: int) -> list[tuple[int, int]]:
    """Ranges of A ids, together all, of about ``limit`` pairs each. Collects a number for each A id of the vocabulary."""
    sizes = sorted((r.a, r.size) for r in counts.groupBy("a").agg(F.count(F.lit(1)).alias("size")).collect())
    ranges, low, held = [], 0, 0
    for a, size in sizes:
        if held and held + size > limit:
            ranges.append((low, a))
            low, held = a, 0
        held += size
    return [*ranges, (low, sizes[-1][0] + 1 if sizes else 1)]


_KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]


def _weighed(table):
    """The documents with, over their links with a pair in the table, how many are best and the sum of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number, best = table.value
        for batch in batches:
            lists, weights = batch.column("pairs"), batch.column("times")
            pairs, times = lists.flatten().to_numpy(), weights.flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            sums = np.zeros((2, len(lists)), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                inside = known[at] == pairs
                at, times, owner = at[inside], times[inside], owner[inside]
                np.add.at(sums[0], owner, times * best[at])
                np.add.at(sums[1], owner, times * number[at])
            columns = [batch.column(c) for c in ["row", *_KEPT]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums[0]), pa.array(sums[1])], ["row", *_KEPT, "n_best", "count_sum"]
            )

    return run


def weigh(aligned: DataFrame, counts: DataFrame, limit: int = SLICE) -> DataFrame:
    """The documents with ``n_best, count_sum``: a pass over their pairs for each slice of the counts."""
    spark = aligned.sparkSession
    schema = (
        "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
        " groups string, n_best bigint, count_sum bigint"
    )
    passes = []
    for low, high in _slices(counts, limit):
        rows = counts.where((F.col("a") >= low) & (F.col("a") < high)).select("pair", "n", "best").orderBy("pair").toArrow()
        table = [rows[c].to_numpy() for c in ("pair", "n", "best")]
        shared = spark.sparkContext.broadcast(table)  # a slice: at most SLICE pairs, or one A token's
        passes.append(aligned.mapInArrow(_weighed(shared), schema))
    if len(passes) == 1:
        return passes[0].drop("row")
    sums = (F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return reduce(DataFrame.unionByName, passes).groupBy("row", *_KEPT).agg(*sums).drop("row")


def align_corpus(
    documents: DataFrame,
    byte_vocabulary: str = BYTE_VOCABULARY,
    piece_vocabulary: str = PIECE_VOCABULARY,
    spelled: bool = False,
    limit: int = SLICE,
) -> DataFrame:
    """Per document: ``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, n_best, count_sum``.

    ``groups`` holds the aligned ids as ``a1,a2|b1;a3|b2,b3`` where ``spelled`` is set, else null.
    """
    aligned = align_documents(documents, byte_vocabulary, piece_vocabulary, spelled)
    return weigh(aligned, pair_counts(aligned), limit)
