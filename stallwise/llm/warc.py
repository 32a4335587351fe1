"""WARC archives: writing pages as records, and reading archives of any size in splits.

Writing. A page becomes a response record. Of pages with equal payloads of at
least ``REVISIT_BYTES`` bytes the one with the largest id is the response and the
others are revisit records without payload. Records go through Spark's text
writer with the record terminator as line separator, so the usual commit protocol
covers lost executors.

Reading. Archives are split anywhere. A task cuts its split at every occurrence of
the magic line; each piece is a candidate record whose Content-Length says where
its successor starts. A payload may hold the magic line, too, so a candidate counts
only if the chain of successors from the start of the file reaches it:

1. every candidate's place, successor and, if the piece holds the whole record,
   the payload's length and digest are staged; payloads aren't;
2. within a split each candidate's chain is followed to the first place outside;
3. pointer jumping over these exits, doubling the distance each round, finds where
   the chain from the file's start enters each split;
4. following the chain inside the splits marks the records; the pieces between
   two records belong to the first one;
5. records cut by a magic line in their payload are put together from their
   pieces in a second scan, which takes place only if there are any.

Edge cases: a null html is an empty payload; a null url leaves out its header; CR
and LF in a url are escaped. A null page id is written as an empty id and read as
null; it is never the largest. Repeated rows of the largest id are responses each.
A file that doesn't start with a record yields none. A payload of any length is one record,
held in memory whole by the task that writes or reads it. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallwise.llm.common import arrow_rows
from stallwise.sources.staging import fresh_path, stage

# Fixed values of the format.
MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
BATCH_ROWS = 256

RECORD = (
    "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean"
)


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, date: str = DATE) -> DataFrame:
    """``value``: the text of every page's record, without its terminator."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"n": F.octet_length("payload").cast("long"), "same": F.sha2("payload", 256)})
    groups = rows.where(F.col("n") >= revisit_bytes).groupBy("n", "same")
    groups = groups.agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    groups = stage(groups.select("n", "same", "last"), "repeated")
    rows = rows.join(groups, ["n", "same"], "left")
    revisit = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    def name(page_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))

    size = F.col("n").cast("string")
    head = F.concat_ws("\r\n", F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), header("Content-Length", size))
    block = F.concat(head, F.lit(BREAK), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = F.concat_ws(
        "\r\n",
        header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        header("WARC-Record-ID", name(F.col("page_id"))),
        header("WARC-Date", F.lit(date)),
        header("WARC-Target-URI", url),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        header("WARC-Payload-Length", size),
        F.when(revisit, header("WARC-Refers-To", name(F.col("last")))),
        F.when(revisit, header("WARC-Profile", F.lit(REVISIT_PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response"),
        header("Content-Length", F.octet_length("block").cast("string")),
    )
    rows = rows.withColumn("block", block)
    return rows.select(F.concat(F.lit(MAGIC), fields, F.lit(BREAK), F.col("block")).alias("value"))


def write_archive(pages: DataFrame, path: str, **options) -> None:
    """Write a record for every page, one archive file for each partition."""
    records(pages, **options).write.option("lineSep", BREAK).option("compression", "none").text(path)


def _page(name: bytes | None) -> int | None:
    digits = (name or b"")[len(b"<urn:page:") : -1]
    return int(digits) if digits.lstrip(b"-").isdigit() else None


def _fields(head: bytes) -> dict[bytes, bytes]:
    lines = (line.partition(b":") for line in head.split(b"\r\n"))
    return {name.strip().lower(): value.strip() for name, _, value in lines}


def _sizes(fields: dict[bytes, bytes], head: bytes) -> int | None:
    """Bytes from behind a record's magic line to behind the next one's, null if the header gives none."""
    length = fields.get(b"content-length", b"")
    return len(head) + 2 * len(BREAK) + int(length) + len(MAGIC) if length.isdigit() else None


def _content(fields: dict[bytes, bytes], body: bytes) -> tuple:
    """A whole record's values in the order of ``RECORD``."""
    declared = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
    kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
    page, earlier = _page(fields.get(b"warc-record-id")), _page(fields.get(b"warc-refers-to"))
    if kind == "revisit":
        length = fields.get(b"warc-payload-length", b"")
        return page, kind, earlier, int(length) if length.isdigit() else None, declared, True
    payload = body[: int(fields[b"content-length"])].partition(BREAK.encode())[2]
    digest = hashlib.sha1(payload).hexdigest()
    return page, kind, None, len(payload), digest, digest == declared


def _pieces(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[tuple]:
    """Place within its split, text and header of every piece, in the order of the splits."""
    at: dict[tuple[str, int], int] = {}
    for batch in batches:
        rows = []
        columns = (batch.column("file").to_pylist(), batch.column("split").to_pylist())
        for file, split, text in zip(*columns, batch.column("value").cast(pa.binary())):
            text = text.as_py()
            place = at.get((file, split), 0)
            at[file, split] = place + len(text) + len(MAGIC)
            rows.append((file, split, place, text))
        yield batch, rows


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_INT, _STR = pa.int64(), pa.string()
_CONTENT = [("page_id", _INT), ("record_type", _STR), ("refers_to", _INT), ("payload_bytes", _INT), ("payload_digest", _STR), ("intact", pa.bool_())]
_PLACE = [("file", _STR), ("split", _INT), ("place", _INT)]
_CANDIDATE = pa.schema([*_PLACE, ("size", _INT), ("step", _INT), ("whole", pa.bool_()), *_CONTENT])


def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece: where it lies, where its successor would, and its values if it is a whole record."""
    for _, rows in _pieces(batches, True):
        out = []
        for file, split, place, text in rows:
            head, found, body = text.partition(BREAK.encode())
            fields = _fields(head) if found else {}
            step = _sizes(fields, head)
            # The last record of a file may lack the terminator.
            whole = step is not None and len(text) + len(MAGIC) == step
            values = _content(fields, body) if whole else (None,) * len(_CONTENT)
            out.append((file, split, place, len(text), step, whole, *values))
        yield _table(out, _CANDIDATE)


_TEXT = pa.schema([*_PLACE, ("value", pa.binary())])


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece with its text."""
    for _, rows in _pieces(batches, True):
        yield _table(rows, _TEXT)


def joined_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of records put together from pieces."""
    for batch in batches:
        out = []
        for value in batch.column("value"):
            head, _, body = value.as_py().partition(BREAK.encode())
            out.append(_content(_fields(head), body))
        yield _table(out, pa.schema(_CONTENT))


def _exits(pieces: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split the first place outside it that its chain reaches."""
    pieces = pieces.sort_values("start", ascending=False)
    out: dict[int, int | None] = {}
    for start, following in zip(pieces["start"], pieces["following"]):
        following = None if pd.isna(following) else int(following)
        out[int(start)] = out.get(following, following)
    return pd.DataFrame(
        {"file": pieces["file"].iloc[0], "start": list(out), "exit": pd.array(list(out.values()), "Int64")}
    )


def _owners(pieces: pd.DataFrame) -> pd.DataFrame:
    """The record each piece of a split belongs to: null before the first that starts in the split."""
    pieces = pieces.sort_values("start")
    entry = pieces["entry"].iloc[0]
    wanted = None if pd.isna(entry) else int(entry)
    owner, owners = None, []
    for start, following in zip(pieces["start"], pieces["following"]):
        if wanted is not None and start == wanted:
            owner, wanted = int(start), None if pd.isna(following) else int(following)
        owners.append(owner)
    return pieces[["file", "split", "start"]].assign(owner=pd.array(owners, "Int64"))


def _entries(spans: DataFrame) -> DataFrame:
    """Places where the chain from the start of each file enters splits, by pointer jumping."""
    exits = stage(spans.groupBy("file", "split").applyInPandas(_exits, "file string, start bigint, exit bigint"), "exits")
    first = F.lit(len(MAGIC)).cast("long")
    targets = exits.select("file", F.col("exit").alias("start")).distinct()
    heads = exits.select("file", first.alias("start")).distinct()
    jumps = exits.join(targets.unionByName(heads).distinct(), ["file", "start"], "left_semi").where("exit IS NOT NULL")
    jumps = stage(jumps, "jumps")
    reached = exits.where(F.col("start") == first).select("file", "start")
    reached, known = stage(reached, "reached"), -1
    while (count := reached.count()) != known:
        known = count
        ahead = reached.join(jumps, ["file", "start"]).select("file", F.col("exit").alias("start"))
        reached = stage(reached.unionByName(ahead).distinct(), "reached")
        further = jumps.select("file", F.col("start").alias("exit"), F.col("exit").alias("beyond"))
        twice = jumps.join(further, ["file", "exit"], "left")
        jumps = stage(twice.select("file", "start", F.coalesce("beyond", "exit").alias("exit")), "jumps")
    return reached


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path``: see ``RECORD``; ``intact`` says that the digest was right."""
    scan = spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    )
    place = "file string, split bigint, place bigint"
    with arrow_rows(spark, BATCH_ROWS):
        found = scan.mapInArrow(candidates, f"{place}, size bigint, step bigint, whole boolean, {RECORD}")
        found = stage(found, "candidates")

    length = F.max(F.col("place") + F.col("size") + F.lit(len(MAGIC)))
    splits = found.groupBy("file", "split").agg(length.alias("length"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("length").over(before), F.lit(0))
    splits = stage(splits.select("file", "split", base.alias("base")), "splits")
    start = F.col("base") + F.col("place")
    found = found.join(splits, ["file", "split"]).withColumns({"start": start, "following": start + F.col("step")})
    spans = found.select("file", "split", "start", "following")
    entered = _entries(spans).join(spans.select("file", "split", "start"), ["file", "start"])
    entered = entered.groupBy("file", "split").agg(F.min("start").alias("entry"))
    owned = spans.join(entered, ["file", "split"], "left").groupBy("file", "split")
    owned = stage(owned.applyInPandas(_owners, "file string, split bigint, start bigint, owner bigint"), "owners")

    real = owned.where("owner = start").select("file", "start")
    reached = found.join(real, ["file", "start"])
    names = [name for name, _ in _CONTENT]
    whole = reached.where("whole").select(*names)
    broken = stage(reached.where("NOT whole AND following IS NOT NULL").select("file", F.col("start").alias("owner")), "broken")
    if broken.isEmpty():
        return whole
    return whole.unionByName(_rejoined(scan, splits, owned, broken))


def _rejoined(scan: DataFrame, splits: DataFrame, owned: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds magic lines, put together from a second scan."""
    last = owned.groupBy("file", "split").agg(F.max("owner").alias("last"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("file", "split", F.max("last").over(before).alias("carried"))
    owned = owned.join(carried, ["file", "split"]).select("file", "start", F.coalesce("owner", "carried").alias("owner"))
    wanted = owned.join(broken, ["file", "owner"])
    with arrow_rows(scan.sparkSession, BATCH_ROWS):
        pieces = scan.mapInArrow(texts, "file string, split bigint, place bigint, value binary")
        pieces = pieces.join(splits, ["file", "split"], "left")
        known = F.coalesce("base", F.raise_error(F.lit("the splits of an archive changed between two scans")).cast("long"))
        pieces = pieces.select("file", (known + F.col("place")).alias("start"), "value").join(wanted, ["file", "start"])
        pieces = pieces.groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("p"))
        parts = F.transform("p", lambda piece: piece["value"].cast("string"))
        value = F.array_join(parts, MAGIC).cast("binary")
        return stage(pieces.select(value.alias("value")).mapInArrow(joined_records, RECORD), "joined")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages into archives in the shared folder and read these back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
