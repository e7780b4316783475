"""Batch and upload ingest steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.coerce import coerce_budget
from ..functions.text import blank_to_null, duration_from_transcript, transcript_hash


def read_jsonl(spark: SparkSession, path: str, schema=S.CALL_RECORD) -> DataFrame:
    """JSONL with an explicit schema; blank lines are skipped and a malformed line
    is kept in ``_corrupt`` instead of failing the job (S1 S3)."""
    full = schema.add("_corrupt", "string") if "_corrupt" not in schema.fieldNames() else schema
    return (spark.read.schema(full).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt").json(path))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labelled JSONL (S3): transcript, optional call_id, gold analysis with a typed budget.

    ``budget_given`` tells "not_discussed" (true, NULL budget) from a missing or unusable budget (false).
    """
    raw = read_jsonl(spark, path, S.LABEL_RECORD)
    gold = F.col("label")["extraction"]["budget_range"]
    typed = coerce_budget(gold)
    said = F.try_variant_get(gold, "$", "string") == F.lit("not_discussed")
    return raw.withColumns({"budget_given": typed.isNotNull() | F.coalesce(said, F.lit(False)),
                            "label": F.col("label").withField("extraction.budget_range", typed)})


def typed_time(records: DataFrame) -> DataFrame:
    """Call records with the instant ``ts`` read from the text ``timestamp`` (any ISO offset), which is kept;
    a text that is no time gives a NULL ``ts`` and is quarantined by :func:`split_required` (S1)."""
    if "ts" in records.columns or "timestamp" not in records.columns:
        return records
    return records.withColumn("ts", F.col("timestamp").try_cast("timestamp"))


def split_required(df: DataFrame, required: list[str] = S.CALL_REQUIRED) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): a row missing any required field, or unparsable, fails alone."""
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
    if "_corrupt" in df.columns:
        ok = ok & F.col("_corrupt").isNull()
    flagged = df.withColumn("_ok", ok)
    return flagged.filter("_ok").drop("_ok"), flagged.filter(~F.col("_ok")).drop("_ok")


def pick_transcript(keys: list[str] = S.PAYLOAD_KEYS) -> Column:
    """First non-blank of the payload keys, stripped; NULL when none (P10)."""
    return F.coalesce(*[blank_to_null(k) for k in keys])


def upload_rows(payloads: DataFrame, ingest_ts: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) upload rows with defaults, ids, hash and duration.

    call_id = UPLOAD_<UTC second>_<transcript hash>: unique per content, so
    parallel uploads in one second do not overwrite each other (README, Q13).
    """
    missing = {f.name: F.lit(None).cast("string") for f in S.PAYLOAD.fields if f.name not in payloads.columns}
    p = payloads.withColumns(missing).withColumn("transcript", pick_transcript())
    accepted = p.filter(F.col("transcript").isNotNull())
    rejected = p.filter(F.col("transcript").isNull())
    h = transcript_hash("transcript")
    rows = accepted.select(
        "*",
        h.alias("transcript_hash"),
        F.lit(S.UPLOAD_ID).alias("telecaller_id"),
        F.coalesce(F.nullif(F.col("telecaller_name"), F.lit("")), F.lit(S.UPLOAD_TELECALLER_NAME)).alias("_tc"),
        F.lit(S.UPLOAD_ID).alias("lead_id"),
        F.coalesce(F.nullif(F.col("lead_name"), F.lit("")), F.lit(S.UPLOAD_LEAD_NAME)).alias("_ld"),
        duration_from_transcript("transcript").alias("duration_sec"),
        ingest_ts.alias("ts"))
    rows = rows.drop("telecaller_name", "lead_name").withColumnsRenamed({"_tc": "telecaller_name", "_ld": "lead_name"})
    rows = rows.withColumn("call_id", F.concat(F.lit("UPLOAD_"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit("_"), "transcript_hash"))
    return rows, rejected


def first_n(df: DataFrame, n: int | None) -> DataFrame:
    """The first N records by (timestamp, call_id); N of None or 0 = all (O3, Q19)."""
    if not n:
        return df
    return df.orderBy("ts", "call_id").limit(n)


def batch_summary(results: DataFrame) -> DataFrame:
    """ok / fail / skipped counts of one run."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
