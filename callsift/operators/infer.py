"""Model inference as Spark work: responder runner, retry rounds, attempt log.

The user hands in a *responder factory*: a zero-argument callable run once
per task that returns ``respond(batch: pandas.DataFrame) -> list[str]``, one
reply text per row (a model client, or the replay responder below).  The
runner calls it one transcript at a time, as the reference does, and records
latency and errors per attempt.

Retry rounds replace the in-process retry loop: round k sends every still
pending transcript hash, *writes* the round's attempts to the attempt log
(Parquet in the shared checkpoint folder) and parses the written replies
natively; hashes that validated leave the pending set (an anti-join against
the log).  A round is cut into waves by hash, each written before the next is sent: what
is lost with a task, an executor or the whole run is asked again for one wave only, and a run that is
started again with the same log continues behind the last whole wave.

Beside its replies each wave writes how often each latency occurred, so telemetry adds up
those tables and reads no attempt.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..session import kept, ship_package, work_dir
from . import files
from .analysis import analyze
from .metrics import latency_counts

ResponderFactory = Callable[[], Callable[[pd.DataFrame], list]]
ATTEMPT_SCHEMA = ("transcript_hash string, attempt int, latency_ms double, reply string, error string, "
                  "finished_at double")
#: Transcripts of one wave: what may have to be asked again after a loss.
WAVE = 100_000


class ReplayResponder:
    """Returns the reply recorded in column ``recorded_reply`` (a recorded model run)."""

    def __init__(self, column: str = "recorded_reply", fail_first_attempt: Callable[[str], bool] | None = None):
        self.column = column
        self.fail_first_attempt = fail_first_attempt

    def __call__(self):
        col, flaky = self.column, self.fail_first_attempt

        def respond(batch: pd.DataFrame) -> list:
            if flaky is not None and int(batch["_attempt"].iloc[0]) == 1 and flaky(batch["transcript_hash"].iloc[0]):
                raise TimeoutError("simulated transport failure")
            return list(batch[col])
        return respond


def run_responder(df: DataFrame, factory: ResponderFactory, attempt: int, partitions: int | None = None,
                  min_interval_sec: float = 0.0, rate_per_sec: float | None = None) -> DataFrame:
    """One model call per row (U1): columns transcript_hash, transcript (+ what the responder reads).

    Rows are spread round-robin over ``partitions`` tasks first: the cost of a
    row is one model call whatever its size, so equal row counts balance the
    tasks.  ``min_interval_sec`` paces the calls inside each task (U4), ``rate_per_sec`` those of the whole job: its
    tasks then start together (a barrier stage of as many tasks as there are slots, at most) and each takes an
    equal share of the rate, in turn.
    """
    ship_package(df.sparkSession)
    src = df.withColumn("_attempt", F.lit(attempt))
    if rate_per_sec:
        slots = df.sparkSession.sparkContext.defaultParallelism
        partitions = min(partitions or slots, slots)
    if partitions:
        src = src.repartition(partitions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        respond = factory()
        interval, due = min_interval_sec, 0.0
        if rate_per_sec:
            task = BarrierTaskContext.get()
            tasks = len(task.getTaskInfos())
            task.barrier()
            interval = max(interval, tasks / rate_per_sec)
            due = time.time() + task.partitionId() / rate_per_sec
        for pdf in batches:
            out = []
            for i in range(len(pdf)):
                row = pdf.iloc[i:i + 1]
                if interval:
                    time.sleep(max(0.0, due - time.time()))
                    due = max(due, time.time()) + interval if rate_per_sec else due
                t0 = time.time()
                try:
                    reply = respond(row)[0]
                    lat, err = (time.time() - t0) * 1000.0, None
                except Exception as e:  # noqa: BLE001  (any transport failure is one failed attempt)
                    reply, lat, err = None, None, f"{type(e).__name__}: {e}"
                done = time.time()
                due = max(due, done + interval) if not rate_per_sec else due
                out.append((row["transcript_hash"].iloc[0], attempt, lat, reply, err, done))
            yield pd.DataFrame(out, columns=["transcript_hash", "attempt", "latency_ms", "reply", "error", "finished_at"])

    return src.mapInPandas(run, ATTEMPT_SCHEMA, barrier=bool(rate_per_sec))


def _wave(waves: int) -> Column:
    return F.pmod(F.crc32("transcript_hash"), F.lit(waves))


def _waves(spark: SparkSession, part: str, pending: DataFrame, wave: int) -> int:
    """Into how many waves a round is cut; a round begun before keeps its number."""
    begun = [n for n in files.names(spark, part) if n.startswith("wave=")]
    return int(begun[0].rsplit("-of-", 1)[1]) if begun else max(1, -(-pending.count() // wave))


def infer_with_retries(spark: SparkSession, inputs: DataFrame, factory: ResponderFactory,
                       max_attempts: int = S.MAX_ATTEMPTS, wait_sec: float = S.RETRY_WAIT_SEC,
                       partitions: int | None = None, log_dir: str | None = None,
                       sleep: Callable[[float], None] = time.sleep, min_interval_sec: float = 0.0,
                       rate_per_sec: float | None = None, wave: int = WAVE) -> str:
    """Run retry rounds over ``inputs`` (one row per distinct transcript_hash); return the log path.

    The driver loops over rounds (at most ``max_attempts``) and waves of about ``wave`` transcripts, never over rows.  A
    wave that ``log_dir`` holds whole (a run started again) is not sent again; each round reads only its own replies.
    ``inputs`` is written to the log first, so that it is computed once.
    """
    log = (log_dir or work_dir(spark, f"attempts-{uuid.uuid4().hex[:12]}")).rstrip("/")
    if not files.exists(spark, f"{log}/_inputs/_SUCCESS"):
        inputs.write.mode("overwrite").parquet(f"{log}/_inputs")
    inputs = pending = spark.read.schema(inputs.schema).parquet(f"{log}/_inputs")
    for k in range(1, max_attempts + 1):
        part = f"{log}/round={k}"
        waves = _waves(spark, part, pending, wave)
        for w in range(waves):
            path = f"{part}/wave={w:06d}-of-{waves}"
            if not files.exists(spark, f"{path}/_SUCCESS"):
                asked = pending.where(_wave(waves) == w) if waves > 1 else pending
                run_responder(asked, factory, k, partitions, min_interval_sec, rate_per_sec).write.mode("overwrite").parquet(path)
        # the round's replies are validated once, for the latency counts and for what is still pending
        outcomes = kept(_outcomes(analyze(spark.read.parquet(part)), "transcript_hash", "parse_status"), "outcomes")
        if not files.exists(spark, f"{log}/_latencies/round={k}/_SUCCESS"):
            latency_counts(outcomes).write.mode("overwrite").parquet(f"{log}/_latencies/round={k}")
        failed = outcomes.filter("parse_status <> 'ok'").select("transcript_hash")
        pending = inputs.join(failed, "transcript_hash", "left_semi")
        if k == max_attempts or pending.isEmpty():
            break
        sleep(wait_sec * k)
    return log


def _outcomes(replies: DataFrame, *more: str) -> DataFrame:
    return replies.select(*more, "latency_ms", (F.col("error").isNotNull() | (F.col("parse_status") != "ok")).alias("is_error"))


def logged_latencies(spark: SparkSession, log: str) -> DataFrame:
    """The latency counts of all rounds of a log, without reading its attempts."""
    return spark.read.parquet(f"{log.rstrip('/')}/_latencies").select("latency_ms", "is_error", "n")


def final_results(spark: SparkSession, log: str) -> DataFrame:
    """Per hash: the validated analysis of the attempt that succeeded, else the last attempt,
    with the number of attempts (one grouped pass over the log)."""
    v = analyze(spark.read.parquet(log))
    ranked = v.withColumn("_ok", (F.col("parse_status") == "ok").cast("int"))
    best = F.max_by(F.struct("parse_status", "analysis", "score_quarters", "overall_score"),
                    F.struct(F.col("_ok"), F.col("attempt")))
    agg = ranked.groupBy("transcript_hash").agg(best.alias("_b"), F.count(F.lit(1)).cast("int").alias("attempts"),
                                                F.count("error").cast("int").alias("transport_errors"))
    return agg.select("transcript_hash", "_b.*", "attempts", "transport_errors")


def attempt_log_metrics(spark: SparkSession, log: str) -> DataFrame:
    """Attempt log in the telemetry shape: latency (NULL without a reply) and an error flag per attempt.

    An attempt is an error when the transport failed or its reply did not
    validate; a reply that came back counts as a model call even if it then
    failed validation (the reference records latency before parsing).
    """
    return _outcomes(analyze(spark.read.parquet(log)))
