"""From raw documents to packed sequences, one training-data operator per stage.

Every stage works on all rows that the one before kept, written as Parquet and read
back; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsift.llm import decontam, jaccard, line_dedup, packing, quality
from callsift.llm.common import written
from callsift.session import work_dir


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines whose template an earlier document holds.

    A document that loses four fifths of its characters or more is a near copy by its whole text and goes, so no
    fragment of it reaches the n-gram join.  Null and empty texts lose no line and stay.
    """
    rows = line_dedup.dedup_lines(docs.withColumn("__size", F.length("text")))
    rows = rows.where((F.col("n_dropped") == 0) | (5 * F.length(F.trim(F.regexp_replace("text", "\\s+", " "))) > F.col("__size")))
    size = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return rows.withColumns(size).select(*docs.columns)


def row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with __key: a hash of doc_id and text, so rows without an id can be told apart and repeated rows are one."""
    return docs.withColumn("__key", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): the one with the smallest doc_id, null last.

    Rows that repeat count as copies; rows without words are copies of nothing and all stay.
    """
    keyed = row_key(docs)
    found = jaccard.ngram_join(keyed.select(F.col("__key").alias("doc_id"), "text"), words=5, percent=80)
    found = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias("__copy")).agg(F.min("component_id").alias("root"), F.count("*").alias("n"))
    ids = keyed.select(F.col("__key").alias("__copy"), "doc_id").distinct()
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__copy"))
    first = found.join(ids, "__copy").groupBy("root").agg(F.min_by("__copy", rank).alias("best"))
    found = written(found.join(first, "root").select("__copy", "n", (F.col("__copy") == F.col("best")).alias("kept")), "pipeline-copies")
    gone = found.where("n > 1 or not kept").select(F.col("__copy").alias("__key"))
    repeated = found.where("n > 1 and kept").select(F.col("__copy").alias("__key"))
    return (keyed.join(gone, "__key", "left_anti").unionByName(keyed.join(repeated, "__key", "left_semi").dropDuplicates(["__key"]))
            .select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with or without an id."""
    keyed = row_key(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = decontam.contaminated(keyed.select(F.col("__key").alias("doc_id"), "text"), items).select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(bad, "__key", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 2048 tokens."""
    return packing.packed(docs)


STAGES = [("quality", quality_filter), ("line_dedup", line_templates), ("ngram_join", near_duplicates),
          ("decontamination", decontaminate), ("packing", pack)]

#: The classifier and the tokenizer cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{work_dir(spark, 'pipeline')}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
