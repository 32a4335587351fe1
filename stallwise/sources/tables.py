"""Loading the marketplace tables and querying them by name."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from stallwise.sources.schemas import REQUIRED, SCHEMAS
from stallwise.sources.staging import stage

# How naive timestamps are written in the CSV files.
CSV_OPTIONS = {"header": "true", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss", "dateFormat": "yyyy-MM-dd"}

REJECTED, FILE = "_rejected_line", "_read_from"


class MissingTable(LookupError):
    """An operator needs a table this data set does not have."""


@dataclass(frozen=True)
class TableSet:
    """The tables of one data set. Optional tables may be absent."""

    spark: SparkSession
    frames: Mapping[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        try:
            return self.frames[name]
        except KeyError:
            raise MissingTable(f"table '{name}' is missing; present: {', '.join(sorted(self.frames))}") from None

    def __contains__(self, name: str) -> bool:
        return name in self.frames

    def register(self, prefix: str = "") -> None:
        """Make every table a temp view, replacing one of the same name."""
        for name, frame in self.frames.items():
            frame.createOrReplaceTempView(prefix + name)

    def sql(self, text: str, **args) -> DataFrame:
        """Run ad-hoc SQL over the tables. Named parameters stay out of the text."""
        self.register()
        return self.spark.sql(text, args=args or None)


def load_csv(spark: SparkSession, path: str) -> TableSet:
    """One ``<table>.csv`` file or folder per table, with a header."""
    return _load(spark, path, "csv")


def load_csv_checked(spark: SparkSession, path: str) -> tuple[TableSet, DataFrame]:
    """``load_csv`` of files that may hold broken rows: the tables without these, and the rows that were left out.

    A row is broken if a value doesn't parse as its column's type or the number of values isn't that of the
    columns. Left out rows have ``table, file, line``, the line as it was read; counting them by table says
    how much is missing. Each file is parsed once, whole, into the shared folder: which columns a query
    asks for then has no part in which rows are broken.
    """
    frames, rejected = {}, []
    for name, schema in SCHEMAS.items():
        options = {**CSV_OPTIONS, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECTED}
        reader = spark.read.options(**options).schema(f"{schema}, {REJECTED} string")
        frame = _frame(reader.format("csv"), f"{path}/{name}.csv", name)
        if frame is None:
            continue
        columns = frame.columns[:-1]
        parsed = stage(frame.withColumn(FILE, F.input_file_name()), f"checked-{name}")
        frames[name] = parsed.where(F.col(REJECTED).isNull()).select(columns)
        left_out = parsed.where(F.col(REJECTED).isNotNull())
        rejected.append(left_out.select(F.lit(name).alias("table"), F.col(FILE).alias("file"), F.col(REJECTED).alias("line")))
    return TableSet(spark, frames), reduce(DataFrame.unionByName, rejected)


def load_parquet(spark: SparkSession, path: str) -> TableSet:
    """One ``<table>.parquet`` file or folder per table."""
    return _load(spark, path, "parquet")


def _load(spark: SparkSession, path: str, kind: str) -> TableSet:
    frames = {}
    for name, schema in SCHEMAS.items():
        reader = spark.read.options(**CSV_OPTIONS) if kind == "csv" else spark.read
        frame = _frame(reader.schema(schema).format(kind), f"{path}/{name}.{kind}", name)
        if frame is not None:
            frames[name] = frame
    return TableSet(spark, frames)


def _frame(reader: DataFrameReader, path: str, name: str) -> DataFrame | None:
    """A table's frame, None for an optional table that isn't there."""
    try:
        return reader.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if name in REQUIRED:
            raise MissingTable(f"no {path.rsplit('/', 1)[-1]} under {path.rsplit('/', 1)[0]}") from error
    return None
