"""Registered queries of the training-data operators, opN_<name>, and their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations as op13
from . import decontam as op8
from . import hard_negatives as op12
from . import jaccard as op9
from . import langid as op7
from . import license_scan as op11
from . import line_dedup as op3
from . import lm_score as op1
from . import packing as op2
from . import pivot_index as op4
from . import quality as op5
from . import repair as op10
from . import token_counts as op6
from .common import read_table


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1.ppm_scores(read_table(spark, sf_dir, "documents"))


def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2.packed(read_table(spark, sf_dir, "documents"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op3.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op8_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_pivot_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9.ngram_join(read_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6.token_counts(read_table(spark, sf_dir, "documents"))


def op7_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7.languages(read_table(spark, sf_dir, "documents"))


def op10_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10.read_ids(op10.write_ids(read_table(spark, sf_dir, "documents")))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11.license_labels(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.when(finite, F.transform("embedding", lambda v: F.floor(256 * v.cast("double"))))
    return op12.hard_negatives(rows.select("vec_id", label.alias("label"), x.alias("x")), F.col("vec_id") % 50 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13.collocations(read_table(spark, sf_dir, "documents"))


REGISTRY = {
    "op1_lm_score": op1_lm_score,
    "op2_best_two_fit": op2_best_two_fit,
    "op3_line_templates": op3_line_templates,
    "op4_pivot_near_duplicates": op4_pivot_near_duplicates,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_language_spans": op7_language_spans,
    "op8_simhash_windows": op8_simhash_windows,
    "op9_ngram_join": op9_ngram_join,
    "op10_repair_ids": op10_repair_ids,
    "op11_license_scan": op11_license_scan,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {"op3_line_templates": op3.ORACLE, "op11_license_scan": op11.ORACLE, "op12_hard_negatives": op12.ORACLE,
                            "op13_collocations": op13.ORACLE}
