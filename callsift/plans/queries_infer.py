"""Registered inference and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import transcript_hash
from ..operators import infer
from ..sources import fixtures as FX
from .queries import register


def _inputs(spark, sf_dir):
    """Calls with the recorded model reply of their conversation, one row per distinct transcript."""
    c = FX.calls(spark, sf_dir).join(FX.replies(spark, sf_dir), "conv_id")
    c = c.withColumn("transcript_hash", transcript_hash("transcript"))
    distinct = c.groupBy("transcript_hash").agg(F.min_by(F.struct("transcript", F.col("reply").alias("recorded_reply")),
                                                          F.col("call_id")).alias("_r"))
    return c, distinct.select("transcript_hash", "_r.*")


def _run(spark, sf_dir, responder):
    calls, inputs = _inputs(spark, sf_dir)
    log = infer.infer_with_retries(spark, inputs, responder, wait_sec=0.0)
    res = infer.final_results(spark, log)
    return calls.join(res, "transcript_hash").select("call_id", "parse_status", "attempts", "overall_score")


@register("infer_replay")
def q_infer_replay(spark, sf_dir):
    """Replayed model run through retry rounds: failing replies are retried to the limit."""
    return _run(spark, sf_dir, infer.ReplayResponder())


@register("infer_retry")
def q_infer_retry(spark, sf_dir):
    """As infer_replay, with a transport failure on the first attempt for hashes starting 0-7."""
    flaky = infer.ReplayResponder(fail_first_attempt=lambda h: int(h[0], 16) < 8)
    return _run(spark, sf_dir, flaky)


@register("stream_upload")
def q_stream_upload(spark, sf_dir):
    """Calls uploaded through the file stream: every call once, then again for conv_id % 5 == 0.

    The second set arrives in a later micro-batch, so it is served from the
    store (cached); the answer rows are read back from the response table.
    """
    import uuid

    from ..session import work_dir
    from ..streaming.upload import run_upload_stream

    base = work_dir(spark, f"stream-{uuid.uuid4().hex[:12]}")
    c = FX.calls(spark, sf_dir).join(FX.replies(spark, sf_dir), "conv_id")
    pay = c.select("conv_id", F.col("call_id").alias("doc_key"), "transcript", "telecaller_name", "lead_name",
                   F.col("reply").alias("recorded_reply"))
    first = pay.drop("conv_id")
    again = pay.filter(F.col("conv_id") % 5 == 0).drop("conv_id").withColumn(
        "doc_key", F.concat(F.col("doc_key"), F.lit("#2")))
    for part in (first, again):
        part.write.mode("append").json(f"{base}/in")
        run_upload_stream(spark, f"{base}/in", f"{base}/store", f"{base}/out", infer.ReplayResponder(),
                          f"{base}/ckpt", ingest_ts=F.to_timestamp(F.lit("2026-01-02 03:04:05")),
                          extra_schema="doc_key string, recorded_reply string", wait_sec=0.0)
    return spark.read.parquet(f"{base}/out/responses").select("doc_key", "call_id", "cached", "overall_score", "status")


# ----------------------------------------------------------------- rules analyzer
def _rules(spark, sf_dir):
    from ..operators.rules import rules_analysis
    return rules_analysis(FX.calls(spark, sf_dir).select("call_id", "transcript"))


@register("rules_extraction")
def q_rules_extraction(spark, sf_dir):
    ex = F.col("rules.extraction")
    return _rules(spark, sf_dir).select(
        "call_id", ex["unit_configuration"].alias("unit_configuration"),
        ex["budget_range"]["min_lakhs"].alias("budget_min"), ex["budget_range"]["max_lakhs"].alias("budget_max"),
        ex["timeline"].alias("timeline"), F.array_join(ex["preferred_locations"], "|").alias("preferred_locations"),
        ex["site_visit_outcome"].alias("site_visit_outcome"))


@register("rules_scores")
def q_rules_scores(spark, sf_dir):
    qs = F.col("rules.quality_scores")
    return _rules(spark, sf_dir).select("call_id", *[qs[d]["score"].alias(f"{d}_score") for d in
                                                     ("discovery", "pitch", "objection_handling", "next_step")])


@register("rules_stage_action")
def q_rules_stage_action(spark, sf_dir):
    return _rules(spark, sf_dir).select("call_id", F.col("rules.last_stage_reached").alias("last_stage_reached"),
                                        F.col("rules.recommended_next_action").alias("recommended_next_action"))


@register("rules_text")
def q_rules_text(spark, sf_dir):
    r = F.col("rules")
    return _rules(spark, sf_dir).select("call_id", r["quality_scores"]["discovery"]["reason"].alias("discovery_reason"),
                                        r["quality_scores"]["pitch"]["reason"].alias("pitch_reason"),
                                        r["summary"].alias("summary"))


# ----------------------------------------------------------------- wished-for items
@register("list_date_range")
def q_list_date_range(spark, sf_dir):
    from ..operators.extras import date_score_filter
    from .queries import stored_calls
    st = stored_calls(spark, sf_dir).withColumn("call_date", F.to_date("ts"))
    return st.filter(date_score_filter("2024-01-01 02:00:00", "2024-01-01 05:00:00", 1.0, 3.0)).select(
        "call_id", "overall_score")


@register("eval_visit_partial")
def q_eval_visit_partial(spark, sf_dir):
    from ..operators.extras import visit_partial_credit
    from .queries_ops import _eval_pairs
    return visit_partial_credit(_eval_pairs(spark, sf_dir).filter("parse_status = 'ok'"))


@register("normalized_hash")
def q_normalized_hash(spark, sf_dir):
    from ..operators.extras import normalized_hash
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", normalized_hash("text").alias("norm_hash"))


@register("intro_name")
def q_intro_name(spark, sf_dir):
    from ..operators.extras import intro_name
    return FX.calls(spark, sf_dir).select("call_id", intro_name("transcript").alias("intro_name"))


@register("verifier_disagreements")
def q_verifier_disagreements(spark, sf_dir):
    from ..operators.extras import disagreements
    from ..operators.rules import rules_analysis
    from .queries import stored_calls
    st = stored_calls(spark, sf_dir)
    rules = rules_analysis(FX.calls(spark, sf_dir).select("call_id", "transcript"))
    return disagreements(st, rules)


@register("bulk_reassign")
def q_bulk_reassign(spark, sf_dir):
    """Calls whose lead is in the AUTOMOBILE segment move to one telecaller."""
    from ..operators.store import reassign
    from .queries import stored_calls
    st = stored_calls(spark, sf_dir)
    cust = FX.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "AUTOMOBILE")
    sel = st.join(cust.select(F.concat(F.lit("LEAD_"), F.col("c_custkey").cast("string")).alias("lead_id")), "lead_id",
                  "left_semi")
    return reassign(st, sel, "TC_900", "Reassigned").select("call_id", "telecaller_id", "telecaller_name")


@register("response_record")
def q_response_record(spark, sf_dir):
    """{call_id, cached, ...analysis} per stored call (S7), top-level analysis fields flattened."""
    from ..operators.analysis import response_record
    from .queries import stored_calls
    r = response_record(stored_calls(spark, sf_dir).withColumn("cached", F.lit(False)))
    return r.select("call_id", "cached", F.col("extraction.unit_configuration").alias("unit_configuration"),
                    F.col("quality_scores.pitch.score").alias("pitch_score"), "last_stage_reached",
                    "recommended_next_action", "next_action_reason", "summary")


@register("batch_run")
def q_batch_run(spark, sf_dir):
    """Incremental batch run (U5): the even conversations are stored, then every call is sent;
    returns the run's ok / fail / skipped counts."""
    import uuid

    from ..operators.batch import run_batch
    from ..session import work_dir
    root = work_dir(spark, f"batch-{uuid.uuid4().hex[:12]}")
    c = FX.calls(spark, sf_dir).join(FX.replies(spark, sf_dir), "conv_id").withColumnRenamed("reply", "recorded_reply")
    ts = F.to_timestamp(F.lit("2026-01-02 03:04:05"))
    run_batch(spark, c.filter(F.col("conv_id") % 2 == 0), root, infer.ReplayResponder(), ts, extra=["recorded_reply"])
    _, summary = run_batch(spark, c, root, infer.ReplayResponder(), ts, extra=["recorded_reply"])
    return summary


@register("edit_next_action")
def q_edit_next_action(spark, sf_dir):
    """After edits, the next action follows the edited visit outcome and stage (N4): R8 over the
    edited record with the transcript's lead intents, unless the action itself was edited."""
    from ..operators import store as ST
    from ..operators.rules import intent_flags, next_action
    from .queries import stored_calls
    from .queries_ops import _edits
    out, _ = ST.apply_edits(stored_calls(spark, sf_dir), _edits(spark, sf_dir), keep_edit_columns=True)
    out = intent_flags(out)
    a = F.col("analysis")
    recomputed = next_action(F.col("flags"), a["extraction"]["site_visit_outcome"], a["last_stage_reached"])
    action = (F.when(~F.col("edited"), a["recommended_next_action"])
              .when(F.col(ST.edit_column("recommended_next_action")).isNotNull(), a["recommended_next_action"])
              .otherwise(recomputed))
    return out.select("call_id", action.alias("recommended_next_action"))
