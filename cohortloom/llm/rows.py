"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import settle

SLICE = 512
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents").select(*columns)


def map_rows(df: DataFrame, inputs: dict[str, Column], schema: str,
             start: Callable[[], Callable[[list[list]], Iterable[tuple]]]) -> DataFrame:
    """Rows of ``schema`` made from batches of the given columns.

    ``start`` runs once per task and returns the function that turns the columns
    of a batch, as lists, into row tuples; what it keeps lives as long as the
    task.  Spark bounds its Arrow batches in rows and bytes; they are worked on
    in slices of SLICE rows, so outputs larger than the inputs stay small too.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for part in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            rows = work([column.to_pylist() for column in part.columns])
            columns = list(zip(*rows)) or [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.select(*[c.alias(n) for n, c in inputs.items()]).mapInArrow(run, schema)


def finished(df: DataFrame) -> DataFrame:
    """A settled table; shuffle files of steps that nothing refers to any more are freed now, not when the driver's
    memory happens to fill."""
    out = settle(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def remainder(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % parts
