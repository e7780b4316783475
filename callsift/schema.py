"""Schemas, closed value sets and defaults of the call analysis."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's sets exactly (they are the
# labels the model is asked for and the defaults validation falls back to).
# ---------------------------------------------------------------------------
UNIT_CONFIGS = ["2BHK", "3BHK", "4BHK", "villa", "plot", "not_discussed"]
TIMELINES = ["immediate", "3_to_6_months", "6_to_12_months", "exploring", "unclear"]
SITE_VISIT_OUTCOMES = ["committed_with_date", "committed_no_date", "declined", "not_asked", "call_cut"]
LAST_STAGES = ["greeting", "discovery", "pitch", "objection_handling", "close_attempt", "next_step_confirmed"]
ACTIONS = ["schedule_callback_3_days", "confirm_site_visit", "escalate_to_manager",
           "send_brochure_whatsapp", "mark_cold", "no_action"]
DEFAULT_UNIT = "not_discussed"
DEFAULT_TIMELINE = "unclear"
DEFAULT_VISIT = "not_asked"
DEFAULT_STAGE = "greeting"
DEFAULT_ACTION = "no_action"
DIMENSIONS = ["discovery", "pitch", "objection_handling", "next_step"]
REASON_MAX = 400
ACTION_REASON_MAX = 400
SUMMARY_MAX = 600
# Upload defaults
UPLOAD_TELECALLER_NAME = "Uploaded"
UPLOAD_LEAD_NAME = "Uploaded Lead"
UPLOAD_ID = "UPLOAD"
PAYLOAD_KEYS = ["transcript", "text", "content", "call_transcript"]
# Retry policy of one model call: 3 attempts, waits of 1.5 s and 3.0 s.
MAX_ATTEMPTS = 3
RETRY_WAIT_SEC = 1.5
# List view cap of the reference read path
LIST_CAP = 500
# ---------------------------------------------------------------------------

# The stage progression as listed by the spec table (used by the rules analyzer only).
STAGE_RANK = {s: i + 1 for i, s in enumerate(LAST_STAGES)}

SCORE = T.StructType([T.StructField("score", T.IntegerType()), T.StructField("reason", T.StringType())])
BUDGET = T.StructType([T.StructField("min_lakhs", T.DoubleType()), T.StructField("max_lakhs", T.DoubleType())])
EXTRACTION = T.StructType([
    T.StructField("unit_configuration", T.StringType()),
    T.StructField("budget_range", BUDGET),  # NULL means "not_discussed"
    T.StructField("timeline", T.StringType()),
    T.StructField("preferred_locations", T.ArrayType(T.StringType())),
    T.StructField("site_visit_outcome", T.StringType()),
])
QUALITY = T.StructType([T.StructField(d, SCORE) for d in DIMENSIONS])
ANALYSIS = T.StructType([
    T.StructField("extraction", EXTRACTION),
    T.StructField("quality_scores", QUALITY),
    T.StructField("last_stage_reached", T.StringType()),
    T.StructField("recommended_next_action", T.StringType()),
    T.StructField("next_action_reason", T.StringType()),
    T.StructField("summary", T.StringType()),
])

# Raw call record (JSONL input)
CALL_RECORD = T.StructType([
    T.StructField("call_id", T.StringType()),
    T.StructField("telecaller_id", T.StringType()),
    T.StructField("telecaller_name", T.StringType()),
    T.StructField("lead_id", T.StringType()),
    T.StructField("lead_name", T.StringType()),
    T.StructField("duration_sec", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("transcript", T.StringType()),
])
CALL_REQUIRED = ["call_id", "telecaller_id", "telecaller_name", "lead_id", "lead_name",
                 "duration_sec", "timestamp", "transcript"]

# Labelled record (JSONL): transcript, optional call_id, gold analysis with every part optional;
# the budget is an object or the text "not_discussed"
_GOLD_SCORE = T.StructType([T.StructField("score", T.IntegerType())])
LABEL_RECORD = T.StructType([
    T.StructField("transcript", T.StringType()),
    T.StructField("call_id", T.StringType()),
    T.StructField("label", T.StructType([
        T.StructField("extraction", T.StructType([
            T.StructField(f.name, T.VariantType() if f.name == "budget_range" else f.dataType) for f in EXTRACTION.fields])),
        T.StructField("quality_scores", T.StructType([T.StructField(d, _GOLD_SCORE) for d in DIMENSIONS])),
        T.StructField("last_stage_reached", T.StringType()),
        T.StructField("recommended_next_action", T.StringType()),
    ])),
])

# Upload payload (stream input)
PAYLOAD = T.StructType([T.StructField(k, T.StringType()) for k in
                        PAYLOAD_KEYS + ["telecaller_name", "lead_name"]])

# Stored call (one row per call_id)
STORED_CALL = T.StructType([
    T.StructField("call_id", T.StringType()),
    T.StructField("telecaller_id", T.StringType()),
    T.StructField("telecaller_name", T.StringType()),
    T.StructField("lead_id", T.StringType()),
    T.StructField("lead_name", T.StringType()),
    T.StructField("duration_sec", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("transcript", T.StringType()),
    T.StructField("analysis", ANALYSIS),
    T.StructField("overall_score", T.DoubleType()),
    T.StructField("score_quarters", T.IntegerType()),
    T.StructField("transcript_hash", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("call_date", T.DateType()),
])

# Attempt log of model calls (replaces the process-local counters)
ATTEMPT = T.StructType([
    T.StructField("transcript_hash", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("reply", T.StringType()),
    T.StructField("error", T.StringType()),
])
