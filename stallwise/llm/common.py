"""Column helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words, and what separates the words of benchmark windows.
SPACE = r"[\x20\x09-\x0D]+"
NOT_ITEM_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is. Texts of ASCII only take the fast way."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def words(text: Column, separator: str = SPACE) -> Column:
    """The words of a text as an array, empty for null."""
    return F.coalesce(F.array_remove(F.split(text, separator), ""), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def same_row(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    """Join condition on key columns under which a null equals a null."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def crc32_fold(doc_id: Column, folds: int = 3) -> Column:
    """Fold of a document by the CRC-32 of its id as text; null ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds), F.lit(0).cast("long"))


def returning_memory(run: Callable) -> Callable:
    """A function over Arrow batches that gives back what its task held when it ends.

    Workers serve task after task; freed buffers would otherwise stay with the process.
    """

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return freed memory of Arrow's pool and, where the C library can, of its heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, size: int | None = None):
    """At most ``rows`` rows, and about ``size`` bytes, in each Arrow batch while a stage of wide rows is written."""
    wanted = {"maxRecordsPerBatch": str(rows)} | ({"maxBytesPerBatch": f"{size}b"} if size else {})
    before = {}
    for key, value in wanted.items():
        name = f"spark.sql.execution.arrow.{key}"
        before[name] = spark.conf.get(name)
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
