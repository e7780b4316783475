"""Substring search by an index of three-letter runs.

The texts are written in blocks of ``BLOCK`` rows as they come, and for every block the distinct three-letter runs of its
texts: the runs are combined within a block before the shuffle.  A search reads the rows of the term's runs, keeps the blocks that
hold all of them, and applies the very test of ``views.search_predicate`` on those blocks only.  A term without a run of
three letters (short, or cut by wildcards) is tested on all blocks, so every term gives what a full search gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from .views import search_predicate

#: Rows of a block; parts that the runs are dealt to by hash; blocks that a search names in the scan's filter.
BLOCK, PARTS, NAMED = 64, 32, 1000
#: Runs of a block that a task holds before it makes them distinct.
HELD = 1_000_000


def build(texts: DataFrame, root: str, cols: list[str]) -> None:
    """Write the index of ``texts`` (any columns; ``cols`` are searched) under ``root``."""
    spark = texts.sparkSession
    numbered = texts.withColumn("_block", F.floor(F.monotonically_increasing_id() / BLOCK).cast("long"))
    numbered.write.parquet(f"{root}/texts")
    written = spark.read.parquet(f"{root}/texts")
    lowered = [F.lower(F.col(c).cast("string")).cast("binary").alias(f"_text_{i}") for i, c in enumerate(cols)]
    ship_package(spark)
    rows = written.select("_block", *lowered).mapInArrow(block_runs, "_block long, run string")
    # a block that two tasks read is there twice; the parts hold all rows of a run, so one shuffle serves both steps
    part = F.pmod(F.xxhash64("run"), F.lit(PARTS)).cast("int")
    (rows.withColumn("part", part).repartition(PARTS, "part").distinct().sortWithinPartitions("run", "_block")
     .write.partitionBy("part").parquet(f"{root}/runs"))


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_block, run): the distinct three-letter runs of the rows of a block that follow each other; a run is sorted as one number of 63 bits."""
    block, held = None, []
    for batch in batches:
        for b, *texts in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
            if b != block:
                if held:
                    yield _run_rows(block, held)
                block, held = b, []
            for text in texts:
                letters = np.frombuffer((text.as_py() or b"").decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64)
                held.append(letters[:-2] << 42 | letters[1:-1] << 21 | letters[2:])
            if sum(map(len, held)) > HELD:
                held = [np.unique(np.concatenate(held))]
    if held:
        yield _run_rows(block, held)


def _run_rows(block: int, held: list[np.ndarray]) -> pa.RecordBatch:
    runs = np.unique(np.concatenate(held))
    letters = np.stack([runs >> 42, runs >> 21 & 0x1FFFFF, runs & 0x1FFFFF], axis=1)
    size = (1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000)).sum(axis=1)  # in UTF-8
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = letters.astype("<u4").tobytes().decode("utf-32-le").encode()
    run = pa.StringArray.from_buffers(len(letters), pa.py_buffer(ends), pa.py_buffer(data))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(letters), block, np.int64)), run], names=["_block", "run"])


def term_runs(term: str, literal: bool = False) -> list[str]:
    """The three-letter runs that any match of the term holds; ``%`` and ``_`` break it unless it is literal."""
    t = term.strip().lower()
    pieces = [t] if literal else re.split("[%_]", t)
    return sorted({p[i:i + 3] for p in pieces for i in range(len(p) - 2)})


def blocks(spark: SparkSession, root: str, runs: list[str]) -> DataFrame:
    """_block of every block that holds all the runs."""
    # the parts' numbers are computed by Spark, as they were when the index was written
    named = spark.createDataFrame([(r,) for r in runs], "run string").select("run", F.pmod(F.xxhash64("run"), F.lit(PARTS)).cast("int").alias("part"))
    parts = sorted({r.part for r in named.collect()})  # as many as the term has runs, at most
    rows = spark.read.parquet(f"{root}/runs").where(F.col("part").isin(parts) & F.col("run").isin(runs))
    return rows.groupBy("_block").agg(F.count("*").alias("_n")).where(F.col("_n") == len(runs)).select("_block")


def search(spark: SparkSession, root: str, term: str, cols: list[str], literal: bool = False) -> DataFrame:
    """The indexed rows of which a column holds the term, as ``search_predicate`` says; a blank term gives all."""
    texts = spark.read.parquet(f"{root}/texts")
    test = search_predicate(term, cols=cols, literal=literal)
    if test is None:
        return texts.drop("_block")
    runs = term_runs(term, literal)
    if runs:
        found = blocks(spark, root, runs)
        some = [r[0] for r in found.limit(NAMED + 1).collect()]
        texts = texts.where(F.col("_block").isin(some)) if len(some) <= NAMED else texts.join(found, "_block", "left_semi")
    return texts.where(test).drop("_block")
