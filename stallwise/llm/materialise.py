"""Training-order materialisation: token sequences in keyed random order, in fixed-stride shards.

Documents are tokenised once and staged with their place in a run of rows that follow
each other in a file; summing the runs' totals gives every token a global place, so
sequences of equal length fill up without gaps or padding (but for the last one). A keyed
Feistel permutation with cycle-walking gives sequence ``i`` of ``n`` the global slot
``p(i)`` in [0, n): every slot is used once, and a slot is known without a table. With
``band`` each stretch of so many sequences is permuted in itself, so that a corpus that
comes in training order keeps it from stretch to stretch.

Slots are cut into ranges, a shard each. One shuffle brings the pieces of a range
together; its sequences are written in slot order as records of one stride:

    slot (8 bytes, little endian) | tokens (2 bytes each) | CR LF

so slot ``s`` lies in shard ``s // slots`` at byte ``(s % slots) * stride``, and a
reader resumes anywhere by seeking. The shards go through Spark's text writer with
CR LF as line separator: lost tasks are repeated and files appear on commit only.

Order within the corpus is that of the input's files by name and of the rows in them,
however they are split between tasks; it and the key decide the slots, so runs over the
same files agree on any cluster. What isn't read from files as it is gets staged first.

Edge cases: null and empty texts have no tokens and appear in no sequence. Every
other document ends with the end token. Repeated rows are repeated in the stream.
An empty corpus has no sequences and no shards. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwise.llm.common import arrow_rows, returning_memory
from stallwise.llm.shingles import mix
from stallwise.sources.staging import fresh_path, stage

# The word pattern of the byte-level vocabularies and their free id, used as end of text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
TERMINATOR = "\r\n"

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LENGTH = 2048
SLOTS = 4096  # sequences in a shard: 16 MB
KEY = 20_240_607
ROUNDS = 8
TEXT_ROWS = 256
COMPRESSION = 4  # of the pieces that are shuffled
STAGED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def slots(ids: np.ndarray, count: int, key: int = KEY, band: int | None = None) -> np.ndarray:
    """The keyed permutation of [0, count) at ``ids``, or with ``band`` of each stretch of so many."""
    if band is None or band >= count:
        return _permuted(ids, count, key)
    ids = np.asarray(ids, np.int64)
    out = np.empty(len(ids), np.int64)
    for k in np.unique(ids // band).tolist():
        here, start = ids // band == k, k * band
        own_key = (key + (k + 1) * 0x9E3779B97F4A7C15) % 2**64
        out[here] = start + _permuted(ids[here] - start, min(band, count - start), own_key)
    return out


def _permuted(ids: np.ndarray, count: int, key: int) -> np.ndarray:
    bits = max(1, (int(count - 1).bit_length() + 1) // 2)  # of each half
    mask, shift = np.uint64(2**bits - 1), np.uint64(bits)
    seeds = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key), 21)
    out = np.array(ids, np.uint64)
    outside = np.arange(len(out))
    while len(outside):  # walk along the cycle of the larger power of two until back in range
        left, right = out[outside] >> shift, out[outside] & mask
        for seed in seeds:
            left, right = right, left ^ (mix(right + seed, 22) & mask)
        out[outside] = left << shift | right
        outside = outside[out[outside] >= count]
    return out.astype(np.int64)


def _encoder(vocabulary: bytes, digest: str):
    """Made anew in each task: kept, it would hold memory in workers that go on to other stages."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(digest, pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


_STREAM = pa.schema(
    [
        ("file", pa.string()),
        ("first", pa.int64()),
        ("task", pa.int64()),
        ("start", pa.int64()),
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("tokens", pa.binary()),
    ]
)


def _tokenised(vocabulary):
    """A row per document with tokens: the run of rows it lies in, where it starts in the run, and the tokens.

    A run is known by its file and first row; the task only tells apart what should not occur twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, hashlib.sha1(vocabulary.value).hexdigest())
        task, file, first, last, at = TaskContext.get().partitionId(), None, 0, 0, 0
        for batch in batches:
            rows = []
            for source, row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("file", "row", "doc_id", "text"))):
                if source != file or row != last + 1:
                    file, first, at = source, row, 0
                last = row
                if text:
                    ids = np.array([*encoder.encode_ordinary(text), END], "<u2")
                    rows.append((file, first, task, at, doc_id, len(ids), ids.tobytes()))
                    at += len(ids)
            columns = list(zip(*rows)) or [()] * len(_STREAM)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STREAM)], schema=_STREAM)

    return run


def _with_places(documents: DataFrame) -> DataFrame:
    """``file, row, doc_id, text``: documents with their place in the files they are read from."""
    node = documents._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias"):
        node = node.children().apply(0)
    if not node.nodeName().startswith("LogicalRelation") or "_metadata" in documents.columns:
        documents = stage(documents.select("doc_id", "text"), "documents")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    return documents.select(*place, F.col("doc_id").cast("long").alias("doc_id"), "text")


_PIECE = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), ("at", pa.int64()), ("tokens", pa.binary())])


def _pieces(length: int, per_shard: int, count: int, key: int, band: int | None):
    """Cut the stream at sequence bounds; documents of one batch that meet in a sequence are one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins = batch.column("at").to_numpy()
            tokens = batch.column("tokens").to_pylist()
            order = np.argsort(begins, kind="stable")
            found: list[tuple[int, bytes]] = []  # runs of tokens that follow each other in the corpus
            end, run_at, run_tokens = -1, 0, []
            for k in order:
                if begins[k] != end and run_tokens:
                    found.append((run_at, b"".join(run_tokens)))
                if begins[k] != end:
                    run_at, run_tokens = int(begins[k]), []
                run_tokens.append(tokens[k])
                end = int(begins[k]) + len(tokens[k]) // 2
            if run_tokens:
                found.append((run_at, b"".join(run_tokens)))
            sequence, at, data = [], [], []
            for begin, held in found:
                here, last = begin, begin + len(held) // 2
                while here < last:
                    stop = min(last, (here // length + 1) * length)
                    sequence.append(here // length)
                    at.append(here % length)
                    data.append(zlib.compress(held[2 * (here - begin) : 2 * (stop - begin)], COMPRESSION))
                    here = stop
            slot = slots(np.array(sequence, np.int64), count, key, band)
            columns = [pa.array(slot // per_shard), pa.array(slot), pa.array(at, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_PIECE)

    return run


def _records(length: int):
    """Sequences as records, in the order of the rows: (shard, slot, at) within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, shard, held = None, None, []

        def record() -> tuple[int, bytes]:
            tokens = np.full(length, END, "<u2")
            body = np.frombuffer(b"".join(held), "<u2")
            tokens[: len(body)] = body
            return shard, int(last).to_bytes(8, "little") + tokens.tobytes()

        for batch in batches:
            out = []
            for s, slot, piece in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "tokens"))):
                if slot != last and held:
                    out.append(record())
                    held = []
                last, shard = slot, s
                held.append(zlib.decompress(piece))
            columns = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], ["shard", "record"]
            )
        if held:
            s, body = record()
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([body], pa.binary())], ["shard", "record"])

    return run


def stride(length: int) -> int:
    return 8 + 2 * length + len(TERMINATOR)


def tokenise(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Staged ``doc_id, at, n, tokens``: the tokens of each document and their place in the corpus."""
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a fixed file of about 1 MB
    schema = "file string, first bigint, task bigint, start bigint, doc_id bigint, n bigint, tokens binary"
    path = fresh_path(spark, "tokens")
    with arrow_rows(spark, TEXT_ROWS):
        rows = _with_places(documents).mapInArrow(returning_memory(_tokenised(table)), schema)
        rows.write.options(**STAGED).parquet(path)
    stream = spark.read.schema(schema).parquet(path)
    run = ("file", "first", "task")
    # A row for each stretch of a file that one task read. Parts of one table are named by number, so longer names are later.
    runs = stream.groupBy(*run).agg(F.sum("n").alias("n"))
    before = W.orderBy(F.length("file"), *run).rowsBetween(W.unboundedPreceding, -1)
    bases = stage(runs.select(*run, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    return stream.join(bases, list(run)).select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "tokens")


def write_shards(
    stream: DataFrame, path: str, length: int = LENGTH, per_shard: int = SLOTS, key: int = KEY, band: int | None = None
) -> int:
    """Write the sequences of a token stream; returns their number."""
    spark = stream.sparkSession
    total = stream.agg(F.max(F.col("at") + F.col("n"))).first()[0] or 0
    count = -(-total // length)
    with arrow_rows(spark, 1024):
        pieces = stream.select("at", "tokens").mapInArrow(
            returning_memory(_pieces(length, per_shard, count, key, band)), "shard bigint, slot bigint, at bigint, tokens binary"
        )
        # Slots are spread evenly, so equal ranges of shards are equal partitions.
        shards = max(1, -(-count // per_shard))
        ranges = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
        place = F.floor(F.col("shard") * F.lit(ranges) / F.lit(shards)).cast("int")
        ranges = pieces.repartitionById(ranges, place).sortWithinPartitions("shard", "slot", "at")
        records = ranges.mapInArrow(returning_memory(_records(length)), "shard bigint, record binary")
        records = records.select("shard", F.col("record").cast("string").alias("record"))
        records.write.option("lineSep", TERMINATOR).partitionBy("shard").text(path)
    return count


_SEQUENCE = pa.schema(
    [("slot", pa.int64()), ("shard", pa.int64()), ("byte", pa.int64()), ("n_tokens", pa.int64()), ("tokens_sha256", pa.string())]
)


def _sequences(length: int, per_shard: int, start: int, body: bool):
    size = stride(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _SEQUENCE.append(pa.field("tokens", pa.binary())) if body else _SEQUENCE
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                data = content.as_buffer()
                if data.size % size:
                    raise ValueError(f"shard {shard} is not a whole number of records")
                rows = []
                for place in range(max(0, start - shard * per_shard) * size, data.size, size):
                    record = data.slice(place, size).to_pybytes()
                    slot, tokens = int.from_bytes(record[:8], "little"), record[8 : -len(TERMINATOR)]
                    if slot != shard * per_shard + place // size or record[-2:] != TERMINATOR.encode():
                        raise ValueError(f"shard {shard} has another record at byte {place}")
                    row = (slot, shard, place, length, hashlib.sha256(tokens).hexdigest())
                    rows.append((*row, tokens) if body else row)
                columns = list(zip(*rows)) or [()] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def read_shards(
    spark: SparkSession, path: str, length: int = LENGTH, per_shard: int = SLOTS, start: int = 0, body: bool = False
) -> DataFrame:
    """Sequences from slot ``start`` on, checked record by record: a shard at a time in a task.

    ``slot, shard, byte, n_tokens, tokens_sha256`` and, with ``body``, the ``tokens``.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("shard") >= start // per_shard)
    files = files.select(F.col("shard").cast("long").alias("shard"), "content")
    schema = "slot bigint, shard bigint, byte bigint, n_tokens bigint, tokens_sha256 string" + ", tokens binary" * body
    with arrow_rows(spark, 1):
        return stage(files.mapInArrow(_sequences(length, per_shard, start, body), schema), "sequences")


def sequence_documents(
    stream: DataFrame, count: int, length: int = LENGTH, key: int = KEY, band: int | None = None
) -> DataFrame:
    """``slot, doc_ids``: the documents with tokens in each sequence, at most ``length`` of them, by place."""

    def to_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = slots(batch.column("sequence").to_numpy(), count, key, band)
            yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column("doc_ids")], ["slot", "doc_ids"])

    last = F.floor((F.col("at") + F.col("n") - F.lit(1)) / F.lit(length))
    touched = F.explode(F.sequence(F.floor(F.col("at") / F.lit(length)), last)).alias("sequence")
    held = stream.select("doc_id", "at", touched).groupBy("sequence")
    held = held.agg(F.sort_array(F.collect_list(F.struct("at", "doc_id"))).alias("docs"))
    held = held.select("sequence", F.transform("docs", lambda d: d["doc_id"]).alias("doc_ids"))
    return held.mapInArrow(to_slots, "slot bigint, doc_ids array<bigint>")


def materialise(
    documents: DataFrame,
    path: str | None = None,
    vocabulary: str = VOCABULARY,
    length: int = LENGTH,
    per_shard: int = SLOTS,
    key: int = KEY,
    band: int | None = None,
) -> DataFrame:
    """Write the shards under ``path`` and read them back: a row per sequence, with its documents."""
    spark = documents.sparkSession
    path = path or fresh_path(spark, "shards")
    stream = tokenise(documents, vocabulary)
    count = write_shards(stream, path, length, per_shard, key, band)
    schema = "slot bigint, shard bigint, byte bigint, n_tokens bigint, tokens_sha256 string, doc_ids array<bigint>"
    if not count:
        return spark.createDataFrame([], schema)
    sequences = read_shards(spark, path, length, per_shard)
    return sequences.join(sequence_documents(stream, count, length, key, band), "slot")
