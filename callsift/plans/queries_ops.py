"""Registered queries over views, metrics, rubric, dedup, ingest and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema as S
from ..functions import fmt
from ..functions.coerce import with_boundary
from ..functions.text import transcript_hash
from ..operators import dedup, ingest, metrics, partition_store, rubric, store, views
from ..operators.analysis import analyze
from ..session import kept, work_dir
from ..sources import fixtures as FX
from .queries import register, stored_calls, validated

INGEST_TS = "2026-01-02 03:04:05"


def _ts_text(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _n_conv(spark, sf_dir):
    return FX.n_keys(FX.table(spark, sf_dir, "conversations"), "conv_id")


# ----------------------------------------------------------------- views
@register("list_view")
def q_list_view(spark, sf_dir):
    return views.list_calls(stored_calls(spark, sf_dir)).drop("ts")


@register("list_filtered")
def q_list_filtered(spark, sf_dir):
    rows = views.list_calls(stored_calls(spark, sf_dir), search="budget", cap=None,
                            visit="declined", min_overall=1.0, min_discovery=1)
    return rows.select("call_id", "telecaller_name", "overall_score", "discovery_score", "site_visit_outcome")


@register("list_sorted")
def q_list_sorted(spark, sf_dir):
    """The whole list by overall score (descending, NULLs last)."""
    rows = views.list_projection(stored_calls(spark, sf_dir))
    return views.sort_calls(rows, "overall_score", descending=True).select("call_id", "overall_score")


@register("filter_counts")
def q_filter_counts(spark, sf_dir):
    rows = views.list_projection(stored_calls(spark, sf_dir))
    return views.filter_counts(rows, min_overall=1.5)


@register("telecaller_names")
def q_telecaller_names(spark, sf_dir):
    return views.telecaller_names(stored_calls(spark, sf_dir))


@register("search_calls")
def q_search_calls(spark, sf_dir):
    calls = stored_calls(spark, sf_dir)
    return calls.filter(views.search_predicate("Site Visit")).select("call_id", "lead_name")


@register("search_documents")
def q_search_documents(spark, sf_dir):
    """P4 over every document text (whole texts): matches per source."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    hits = d.filter(views.search_predicate("les_", cols=("text",)))
    return hits.groupBy("source").agg(F.count(F.lit(1)).alias("hits"))


@register("detail_labels")
def q_detail_labels(spark, sf_dir):
    c = stored_calls(spark, sf_dir)
    ex = F.col("analysis.extraction")
    return c.select(
        "call_id",
        F.concat_ws(" · ", "lead_name", "telecaller_name").alias("title"),
        fmt.fmt_date("ts", "+05:30").alias("date_text"),
        fmt.fmt_duration("duration_sec").alias("duration_text"),
        fmt.budget_label(ex["budget_range"]).alias("budget_label"),
        fmt.locations_label(ex["preferred_locations"]).alias("locations_label"),
        fmt.quarters_two_decimals("score_quarters").alias("overall_text"),
        fmt.quarters_one_decimal("score_quarters").alias("list_score_text"),
        fmt.score_band("overall_score").alias("score_band"))


@register("call_lookup")
def q_call_lookup(spark, sf_dir):
    ev = FX.table(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    keys = ev.select(F.concat(F.lit("CALL_"), FX.padded(F.col("event_id") % _n_conv(spark, sf_dir), 6)).alias("call_id"))
    return views.lookup(stored_calls(spark, sf_dir), keys).select("call_id", "lead_name", "overall_score")


@register("call_count")
def q_call_count(spark, sf_dir):
    return stored_calls(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- metrics
def latency_rounds(spark, sf_dir) -> DataFrame:
    """The latency counts of three model rounds (events by event_id % 3), each a part of one written table."""
    e = FX.table(spark, sf_dir, "events")
    rounds = e.select((F.col("event_id") % 3).alias("round"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("is_error"))
    return kept(rounds.groupBy("round", "latency_ms", "is_error").agg(F.count(F.lit(1)).alias("n")), "latencies")


@register("latency_telemetry")
def q_latency_telemetry(spark, sf_dir):
    n = stored_calls(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return metrics.telemetry(latency_rounds(spark, sf_dir), n)


@register("latency_percentiles")
def q_latency_percentiles(spark, sf_dir):
    return metrics.rank_rule_percentiles(latency_rounds(spark, sf_dir), "latency_ms", [0.5, 0.9, 0.95, 0.99], "n")


def _eval_pairs(spark, sf_dir) -> DataFrame:
    """Gold = validated reply of conv c (every 10th without scores); prediction = reply of c + 1."""
    v = kept(validated(spark, sf_dir).select("conv_id", "analysis", "parse_status"), "validated")  # read as gold and as prediction
    gold = v.filter("parse_status = 'ok'").select("conv_id", "analysis")
    nulled = F.col("analysis")
    for d in S.DIMENSIONS:
        nulled = nulled.withField(f"quality_scores.{d}.score",
                                  F.when(F.col("conv_id") % 10 == 0, F.lit(None).cast("int"))
                                  .otherwise(F.col(f"analysis.quality_scores.{d}.score")))
    gold = gold.select("conv_id", nulled.alias("gold"))
    pred = v.select((F.col("conv_id") - 1).alias("conv_id"), F.col("analysis").alias("pred"), "parse_status")
    return gold.join(pred, "conv_id")


@register("eval_fields")
def q_eval_fields(spark, sf_dir):
    return metrics.field_accuracy(_eval_pairs(spark, sf_dir).filter("parse_status = 'ok'"))


@register("eval_dimensions")
def q_eval_dimensions(spark, sf_dir):
    return metrics.dimension_accuracy(_eval_pairs(spark, sf_dir).filter("parse_status = 'ok'"))


@register("eval_failures")
def q_eval_failures(spark, sf_dir):
    return _eval_pairs(spark, sf_dir).groupBy("parse_status").agg(F.count(F.lit(1)).alias("n"))


def _label_pairs(spark, sf_dir) -> DataFrame:
    """Labels written as JSONL and read back, each with its prediction.  Budgets are missing, "not_discussed"
    or an object by conv_id % 3; every fourth label has no call_id and is paired by its transcript."""
    c = FX.calls(spark, sf_dir)
    m = F.col("conv_id") % 3
    budget = F.when(m == 1, F.lit('"not_discussed"')).when(m == 2, F.lit('{"min_lakhs": 0, "max_lakhs": 60}'))
    label = F.struct(
        F.struct(F.lit("2BHK").alias("unit_configuration"), F.parse_json(budget).alias("budget_range"),
                 F.lit("immediate").alias("timeline")).alias("extraction"),
        F.lit("pitch").alias("last_stage_reached"), F.lit("mark_cold").alias("recommended_next_action"))
    path = f"{work_dir(spark, 'labels')}/{uuid.uuid4().hex}"
    c.select(F.to_json(F.struct("transcript", F.when(F.col("conv_id") % 4 != 0, F.col("call_id")).alias("call_id"),
                                label.alias("label")))).write.text(path)
    labels, _ = ingest.split_required(ingest.read_labels(spark, path), ["transcript", "label"])
    preds = c.join(validated(spark, sf_dir), "conv_id").select(
        "call_id", transcript_hash("transcript").alias("transcript_hash"), F.col("analysis").alias("pred"), "parse_status")
    return metrics.pair_labels(preds, labels)


@register("label_accuracy")
def q_label_accuracy(spark, sf_dir):
    """Field accuracy against a labels file."""
    return metrics.field_accuracy(_label_pairs(spark, sf_dir).filter("parse_status = 'ok'"))


@register("label_failures")
def q_label_failures(spark, sf_dir):
    """The labels without a valid prediction, with the reason."""
    return _label_pairs(spark, sf_dir).filter("parse_status <> 'ok'").select("call_id", "transcript_hash", "parse_status")


@register("eval_labels")
def q_eval_labels(spark, sf_dir):
    """Accuracy of two document rules against the labels table (A5 on 0/1 fields)."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    lab = FX.table(spark, sf_dir, "labels")
    j = lab.join(d, "doc_id")
    pq = (F.col("n_chars") >= 300).cast("int")
    pt = F.lower("text").contains("hate").cast("int")
    agg = j.agg(F.count(F.lit(1)).alias("total"), F.count_if(pq == F.col("quality")).alias("c_quality"),
                F.count_if(pt == F.col("toxic")).alias("c_toxic"))
    long = agg.select("total", F.expr("stack(2, 'quality', c_quality, 'toxic', c_toxic) as (field, correct)"))
    return long.select("field", F.col("correct").cast("long").alias("correct"), F.col("total").cast("long").alias("total"),
                       F.bround(F.col("correct") * 100.0 / F.col("total"), 1).alias("pct"))


# ----------------------------------------------------------------- rubric / prompt
@register("prompt_messages")
def q_prompt_messages(spark, sf_dir):
    c = FX.calls(spark, sf_dir).select("call_id", rubric.prompt_messages("transcript").alias("messages"))
    m = F.col("messages")
    return c.select("call_id", F.size(m).cast("int").alias("n_messages"),
                    m[0]["role"].alias("first_role"), F.length(m[0]["content"]).alias("system_chars"),
                    F.sha2(m[0]["content"], 256).alias("system_sha"), F.sha2(m[1]["content"], 256).alias("user_sha"))


@register("score_anchor")
def q_score_anchor(spark, sf_dir):
    s = rubric.score_anchors(stored_calls(spark, sf_dir), rubric.rubric_table(spark))
    return s.select("call_id", "dimension", F.col("score").cast("int").alias("score"), "anchor",
                    fmt.dimension_label("dimension").alias("dimension_label"))


# ----------------------------------------------------------------- dedup
@register("skip_seen")
def q_skip_seen(spark, sf_dir):
    calls = FX.calls(spark, sf_dir)
    seen = calls.filter(F.col("conv_id") % 2 == 0)
    return dedup.skip_seen(calls, seen).select("call_id")


def _doc_calls(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("call_id"),
                    transcript_hash("text").alias("transcript_hash"))


@register("cache_hits")
def q_cache_hits(spark, sf_dir):
    d = _doc_calls(spark, sf_dir)
    st = d.filter(F.col("doc_id") % 2 == 0)
    batch = d.filter(F.col("doc_id") % 2 == 1).select("doc_id", "transcript_hash")
    return dedup.cache_lookup(batch, st, created=None).select("doc_id", "cached", "cached_call_id")


@register("dedup_by_hash")
def q_dedup_by_hash(spark, sf_dir):
    d = _doc_calls(spark, sf_dir)
    return dedup.in_batch_duplicates(d, "transcript_hash", "doc_id").select(
        "doc_id", F.col("first_key").alias("first_doc_id"), "is_first")


# ----------------------------------------------------------------- ingest
def _payloads(spark, sf_dir) -> DataFrame:
    """Documents as upload payloads: the text under key doc_id % 4, every 13th blank."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    body = F.when(F.col("doc_id") % 13 == 0, F.lit("  \n ")).otherwise(F.col("text"))
    cols = {k: F.when(F.col("doc_id") % 4 == i, body) for i, k in enumerate(S.PAYLOAD_KEYS)}
    tc = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.col("source"))
    ld = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("lang"))
    return d.select("doc_id", *[c.cast("string").alias(k) for k, c in cols.items()],
                    tc.cast("string").alias("telecaller_name"), ld.cast("string").alias("lead_name"))


@register("payload_pick")
def q_payload_pick(spark, sf_dir):
    p = _payloads(spark, sf_dir).withColumn("_t", ingest.pick_transcript())
    return p.select("doc_id", F.col("_t").isNotNull().alias("accepted"), transcript_hash("_t").alias("transcript_hash"),
                    F.length("_t").alias("picked_chars"))


@register("upload_defaults")
def q_upload_defaults(spark, sf_dir):
    rows, _ = ingest.upload_rows(_payloads(spark, sf_dir), F.to_timestamp(F.lit(INGEST_TS)))
    return rows.select("doc_id", "call_id", "telecaller_id", "telecaller_name", "lead_id", "lead_name", "duration_sec")


@register("required_fields")
def q_required_fields(spark, sf_dir):
    c = FX.calls(spark, sf_dir)
    raw = c.select("conv_id", "call_id",
                   F.when(F.col("conv_id") % 15 == 7, F.lit(None)).otherwise(F.col("telecaller_id")).alias("telecaller_id"),
                   "telecaller_name", "lead_id",
                   F.when(F.col("conv_id") % 10 == 3, F.lit(None)).otherwise(F.col("lead_name")).alias("lead_name"),
                   "duration_sec", _ts_text().alias("timestamp"), "transcript")
    ok, bad = ingest.split_required(raw)
    return ok.select("call_id", F.lit(True).alias("valid")).unionByName(bad.select("call_id", F.lit(False).alias("valid")))


@register("ingest_summary")
def q_ingest_summary(spark, sf_dir):
    calls = FX.calls(spark, sf_dir)
    seen = calls.filter(F.col("conv_id") % 2 == 0).select("call_id")
    todo = dedup.skip_seen(calls, seen)
    v = validated(spark, sf_dir).select("conv_id", "parse_status")
    done = todo.join(v, "conv_id", "left").select(
        F.when(F.col("parse_status") == "ok", F.lit("ok")).otherwise(F.lit("fail")).alias("status"))
    skipped = calls.join(seen, "call_id", "left_semi").select(F.lit("skipped").alias("status"))
    return ingest.batch_summary(done.unionByName(skipped))


@register("first_n")
def q_first_n(spark, sf_dir):
    return ingest.first_n(FX.calls(spark, sf_dir), 25).select("call_id", _ts_text().alias("timestamp"))


# ----------------------------------------------------------------- store
def _ok_replies(spark, sf_dir):
    return kept(validated(spark, sf_dir).filter("parse_status = 'ok'").select(
        "conv_id", "analysis", "score_quarters", "overall_score"), "validated")


def _store_and_batch(spark, sf_dir, v=None):
    calls = FX.calls(spark, sf_dir)
    # both sides read the validated replies: written once rather than validated twice
    v = _ok_replies(spark, sf_dir) if v is None else v
    old = (calls.filter(F.col("conv_id") % 2 == 0).join(v, "conv_id")
           .withColumn("transcript_hash", transcript_hash("transcript")))
    nxt = v.withColumn("conv_id", F.col("conv_id") - 1)
    batch = (calls.join(nxt, "conv_id")
             .withColumns({"lead_name": F.upper("lead_name"),
                           "transcript": F.concat(F.col("transcript"), F.lit("\n[resent]"))})
             .withColumn("transcript_hash", transcript_hash("transcript")))
    return old, batch


@register("upsert_calls")
def q_upsert_calls(spark, sf_dir):
    """Two merges into a stored table (M1 M4): the first creates it, the second sends every call again with other values."""
    old, batch = _store_and_batch(spark, sf_dir)
    root = f"{work_dir(spark, 'upsert')}/{uuid.uuid4().hex}"
    partition_store.merge(spark, root, old, F.col("b.ts"))
    partition_store.merge(spark, root, batch, F.to_timestamp(F.lit(INGEST_TS)))
    m = partition_store.calls(spark, root)
    return m.select("call_id", "lead_name", "transcript_hash", "overall_score", _ts_text("created_at").alias("created_at"),
                    F.col("call_date").cast("string").alias("call_date"))


def _edits(spark, sf_dir) -> DataFrame:
    e = FX.table(spark, sf_dir, "events").select("event_id", "ts")
    fields = list(store.EDITABLE)
    eid = F.col("event_id")
    field = F.when(eid % 10 == 9, F.lit("extraction.bogus"))
    for i, f in enumerate(fields):
        field = field.when(eid % len(fields) == i, F.lit(f))
    e = with_boundary(e, {"field": field})
    field, value = F.col("field"), F.lit(None).cast("string")
    for f, allowed in store.EDITABLE.items():
        if allowed == "score":
            cand = F.concat(F.lit(" "), ((eid / len(fields)).cast("long") % 7).cast("string"))
        else:
            opts = list(allowed) + ["bogus"]
            cand = F.element_at(F.array(*[F.lit(o) for o in opts]), ((eid / len(fields)).cast("long") % len(opts) + 1).cast("int"))
        value = F.when(field == f, cand).otherwise(value)
    value = F.coalesce(value, F.lit("x"))
    return e.select(F.concat(F.lit("CALL_"), FX.padded(eid % _n_conv(spark, sf_dir), 6)).alias("call_id"),
                    "field", value.alias("value"), F.col("ts").cast("timestamp").alias("edited_at"), eid.alias("edit_id"))


@register("apply_edits")
def q_apply_edits(spark, sf_dir):
    st = stored_calls(spark, sf_dir)
    out, _ = store.apply_edits(st, _edits(spark, sf_dir))
    a = F.col("analysis")
    return out.select("call_id", a["extraction"]["site_visit_outcome"].alias("site_visit_outcome"),
                      a["extraction"]["timeline"].alias("timeline"), a["last_stage_reached"].alias("last_stage_reached"),
                      a["recommended_next_action"].alias("recommended_next_action"),
                      *[a["quality_scores"][d]["score"].alias(f"{d}_score") for d in S.DIMENSIONS],
                      "overall_score", "edited")


@register("edit_quarantine")
def q_edit_quarantine(spark, sf_dir):
    st = stored_calls(spark, sf_dir)
    _, bad = store.apply_edits(st, _edits(spark, sf_dir))
    return bad.select("call_id", "field", "reason")
