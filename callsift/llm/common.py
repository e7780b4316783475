"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package, work_dir

#: Rows in one Arrow batch; with texts of a few KB a batch is a few MB.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and keep Arrow batches small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder below ``spark.checkpoint.dir`` and read it back.

    It cuts the lineage: a lost executor does not recompute what came before.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark, 'llm')}/{name}-{uuid.uuid4().hex}"
    w = df.write.partitionBy(by) if by else df.write
    w.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text has remainder 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == 2


def batches(schema: pa.Schema, columns: dict, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Cut equally long columns into record batches."""
    table = pa.table({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)
    yield from table.to_batches(max_chunksize=rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fresh_id() -> int:
    """A random number for a block of rows; a retried task draws another, and its lost rows are never read."""
    return uuid.uuid4().int >> 66


def planes(ids: np.ndarray) -> bytes:
    """32-bit numbers as four rows of bytes: small numbers compress to little more than their low bytes."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def group_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive slices; slice i ends where slice i+1 starts, none is empty."""
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)
