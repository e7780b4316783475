"""Incremental batch run over call records.

records -> required fields (S2) -> first N (O3) -> skip stored call_ids (J1)
-> one model call per distinct transcript (J3 + retry rounds U3) -> score (P14)
-> hash (V11) -> merge into the store (M1) -> ok / fail / skipped (S8).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions.text import transcript_hash
from ..session import kept
from . import infer, ingest, partition_store


def run_batch(spark: SparkSession, records: DataFrame, root: str, responder: infer.ResponderFactory, batch_ts: Column,
              force: bool = False, limit: int | None = None, partitions: int | None = None, extra: list[str] | None = None,
              min_interval_sec: float = 0.0, rate_per_sec: float | None = None, log_dir: str | None = None,
              buckets: int = partition_store.BUCKETS) -> tuple[int, DataFrame]:
    """Process new records into the store at ``root``; return (number of its version, summary counts).

    ``records`` has the call-record columns, the time as instant ``ts`` or as ISO text ``timestamp``; ``extra``
    names pass-through columns the responder reads (e.g. a recorded reply).  Of the rows of
    one call_id, in order of time, the first that validates is stored: those before it
    failed, those after it are skipped.  A run that broke off continues if it is given the same ``log_dir``.
    ``buckets`` sizes the side tables of a store that is begun here.
    """
    valid, bad = ingest.split_required(ingest.typed_time(records), required=[
        "ts" if c == "timestamp" else c for c in S.CALL_REQUIRED])
    n_bad = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("fail").alias("status"), "n")
    # read for the model's inputs, the merge and the counts: written once
    valid = kept(ingest.first_n(valid, limit).withColumn("transcript_hash", transcript_hash("transcript")), "records")
    begun = partition_store.version(spark, root).number
    todo = valid if force else partition_store.unseen(spark, root, valid, begun)
    n_skipped = valid.join(todo.select("call_id"), "call_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("skipped").alias("status"), "n")
    passthrough = [c for c in (extra or []) if c in todo.columns]
    inputs = todo.groupBy("transcript_hash").agg(
        F.min_by(F.struct("transcript", *passthrough), F.col("call_id")).alias("_r")).select("transcript_hash", "_r.*")
    log = infer.infer_with_retries(spark, inputs, responder, partitions=partitions, min_interval_sec=min_interval_sec, rate_per_sec=rate_per_sec,
                                   log_dir=log_dir or f"{root.rstrip('/')}/_attempts/{uuid.uuid4().hex[:12]}")
    res = kept(infer.final_results(spark, log), "results")
    done = todo.join(res, "transcript_hash")
    names = ["telecaller_id", "telecaller_name", "lead_id", "lead_name", "duration_sec", "ts", "transcript",
             "analysis", "overall_score", "score_quarters", "transcript_hash"]
    place = F.struct("ts", "transcript_hash", *names[:5])
    ok = (done.filter("parse_status = 'ok'").groupBy("call_id").agg(F.min_by(F.struct(*names), place).alias("_r"))
          .select("call_id", "_r.*"))
    number = partition_store.merge(spark, root, ok, batch_ts, buckets=buckets)
    first = done.groupBy("call_id").agg(F.min(F.when(F.col("parse_status") == "ok", place)).alias("first"),
                                        F.count(F.lit(1)).alias("rows"))
    early = (done.select("call_id", place.alias("place"), "parse_status").join(first, "call_id")
             .filter("parse_status <> 'ok' and (first is null or place < first)").groupBy("call_id").agg(F.count(F.lit(1)).alias("failed")))
    per_id = first.join(early, "call_id", "left").select(
        "rows", F.col("first").isNotNull().cast("long").alias("ok"), F.coalesce("failed", F.lit(0)).alias("failed"))
    counts = per_id.select(F.expr("stack(3, 'ok', ok, 'fail', failed, 'skipped', rows - ok - failed) as (status, n)"))
    counts = counts.unionByName(n_bad).unionByName(n_skipped)
    return number, counts.groupBy("status").agg(F.sum("n").alias("n")).filter("n > 0")
