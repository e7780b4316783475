"""Call data derived from the driver's tables (FIXTURES.md section 3).

The driver tables hold invented text with no sales vocabulary, so each Agent
and Lead turn of ``conversations`` gets a phrase from a fixed 20-row table;
telecallers come from ``supplier``, leads from ``customer`` and call times
from ``events``.  Everything here is a lazy DataFrame plan: each derived
table grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import transcript_hash

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

# The phrase table of the fixture definition (pid, speaker, phrase).
PHRASES = [
    (0, "Agent", "Good morning sir, Kavya here from Lake View Homes"),
    (1, "Agent", "What budget do you have in mind, sir?"),
    (2, "Agent", "When are you planning to buy?"),
    (3, "Agent", "Are you looking for 2BHK or 3BHK?"),
    (4, "Agent", "Price starts at 55 lakhs, 1200 sqft, RERA approved"),
    (5, "Agent", "Clubhouse and pool are there, and EMI is around 30K"),
    (6, "Agent", "Metro is 10 min away, OMR is 15 min by road"),
    (7, "Agent", "Do not worry sir, it is a good project"),
    (8, "Agent", "Can you come for a site visit on Saturday 11 AM?"),
    (9, "Agent", "I will send the brochure on WhatsApp"),
    (10, "Lead", "yes, sollunga"),
    (11, "Lead", "Budget 60-75 lakhs"),
    (12, "Lead", "3BHK venum"),
    (13, "Lead", "within 3 to 6 months"),
    (14, "Lead", "I am looking in Velachery or OMR"),
    (15, "Lead", "I work in Guindy, location is too far"),
    (16, "Lead", "price is too high"),
    (17, "Lead", "okay, Saturday 11 AM is fine"),
    (18, "Lead", "let me discuss with family and tell you"),
    (19, "Lead", "not interested, call pannadheenga"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_keys(t: DataFrame, key: str) -> F.Column:
    """Size of the key range 0..n-1 of a table, as a scalar subquery: derived keys spread over the whole table."""
    return t.agg(F.max(key) + 1).scalar()


def phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHRASES, "pid int, speaker string, phrase string")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, start_sec, end_sec, speaker, utterance) per conversation turn.

    The phrase table is a 20-row literal, so broadcasting it is safe at any
    scale; the conversations side streams through without a shuffle.
    """
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    pid = (F.when(F.col("role") == "assistant", (F.col("conv_id") * 7 + F.col("turn") * 3) % 10)
           .when(F.col("role") == "user", 10 + (F.col("conv_id") * 3 + F.col("turn") * 7) % 10))
    p = F.broadcast(phrases(spark))
    j = c.withColumn("_pid", pid).join(p, F.col("_pid") == p["pid"], "left")
    return j.select(
        "conv_id", "turn",
        (F.col("turn") * 12).alias("start_sec"),
        (F.col("turn") * 12 + 5 + F.length("text") % 7).alias("end_sec"),
        F.coalesce(F.col("speaker"), F.lit("System")).alias("speaker"),
        F.coalesce(F.col("phrase"), F.regexp_replace("text", "\n", " ")).alias("utterance"),
    )


def padded(c, width: int) -> F.Column:
    """Zero-padded decimal text; longer numbers stay whole."""
    text = c.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def _mmss(c) -> F.Column:
    return F.concat(padded(F.floor(c / 60), 2), F.lit(":"), padded((c % 60).cast("int"), 2))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, transcript, duration_sec): turns rendered as transcript lines in turn order.

    One group per conversation: a transcript is a single value by the data
    model, and its lines are bounded by the length of one call.  Partial
    aggregation does not apply to an ordered concatenation, so the lines are
    gathered with their turn number and sorted inside the group.
    """
    t = turns(spark, sf_dir)
    line = F.concat(F.lit("["), _mmss(F.col("start_sec")), F.lit("-"), _mmss(F.col("end_sec")), F.lit("] "),
                    F.col("speaker"), F.lit(": "), F.col("utterance"))
    g = t.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("_lines"),
        F.max("end_sec").alias("duration_sec"))
    return g.select("conv_id", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("transcript"),
                    "duration_sec")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call records: call_id, telecaller, lead, duration, ts, transcript (+ conv_id).

    Dimension joins are plain equi-joins; the planner broadcasts a dimension
    only when its measured size is under spark.sql.autoBroadcastJoinThreshold
    (AQE re-plans with runtime sizes), otherwise it sort-merge joins.
    """
    x = transcripts(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    k = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    x = x.withColumns({"s_suppkey": F.col("conv_id") % n_keys(s, "s_suppkey"),
                       "c_custkey": (F.col("conv_id") * 17) % n_keys(k, "c_custkey")})
    j = x.join(s, "s_suppkey").join(k, "c_custkey").join(e, e["event_id"] == x["conv_id"])
    return j.select(
        F.concat(F.lit("CALL_"), padded(F.col("conv_id"), 6)).alias("call_id"),
        F.concat(F.lit("TC_"), padded(F.col("s_suppkey"), 3)).alias("telecaller_id"),
        F.col("s_name").alias("telecaller_name"),
        F.concat(F.lit("LEAD_"), F.col("c_custkey").cast("string")).alias("lead_id"),
        F.col("c_name").alias("lead_name"),
        "duration_sec", F.col("ts").cast("timestamp").alias("ts"), "transcript", "conv_id",
    )


def reply_body() -> F.Column:
    """The model-reply JSON text of the fixture, varied by conv_id to hit every coercion case."""
    c = F.col("conv_id")

    def case(m, options, default):
        e = None
        for k, v in options:
            e = (F.when(c % m == k, F.lit(v)) if e is None else e.when(c % m == k, F.lit(v)))
        return e.otherwise(F.lit(default))

    unit = case(7, [(0, '" 3BHK "'), (1, '"3bhk"'), (2, "4"), (3, '"villa"')], '"2BHK"')
    budget = case(9, [(0, '"not_discussed"'), (1, '{"min_lakhs": 70, "max_lakhs": 55}'), (2, '{"min_lakhs": "42"}'),
                      (3, '{"min_lakhs": null, "max_lakhs": 60}'), (4, '{"max_lakhs": 60}'),
                      (5, '{"min_lakhs": 0, "max_lakhs": 0}'), (6, "null"), (7, '{"min_lakhs": -5, "max_lakhs": 30.5}')],
                  "[40, 50]")
    timeline = case(4, [(0, "immediate"), (1, "3_to_6_months"), (2, "soon")], "exploring")
    locs = case(6, [(0, '["OMR", " Velachery ", ""]'), (1, "null"), (2, "[]"), (3, '["Guindy", null, 12, true]'),
                    (4, '"OMR"')], '["omr", "OMR"]')
    visit = case(5, [(0, "committed_with_date"), (1, "declined"), (2, "call_cut"), (3, "committed_no_date")], "maybe")
    objection = case(3, [(0, "null"), (1, '{"score": 4}')], '{"score": "4/5"}')
    action = case(2, [(0, "mark_cold")], "call later")
    return F.concat(
        F.lit('{"extraction": {"unit_configuration": '), unit,
        F.lit(', "budget_range": '), budget,
        F.lit(', "timeline": "'), timeline,
        F.lit('", "preferred_locations": '), locs,
        F.lit(', "site_visit_outcome": "'), visit,
        F.lit('"}, "quality_scores": {"discovery": {"score": '), (c % 8 - 1).cast("string"),
        F.lit(', "reason": "asked budget"}, "pitch": {"score": "'), (c % 6).cast("string"),
        F.lit('.5", "reason": null}, "objection_handling": '), objection,
        F.lit(', "next_step": {"score": true}}, "last_stage_reached": "pitch", "recommended_next_action": "'), action,
        F.lit('", "summary": "Two sentences. Here."}'),
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, reply): one raw model reply per conversation, in every failure shape."""
    # the ids are a few bytes each: a plain distinct is joined into one partition by adaptive execution, and one task would
    # make and validate all replies; a shuffle with a number of its own is left as it is, and the distinct needs no other
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = table(spark, sf_dir, "conversations").select("conv_id").repartition(parts, "conv_id").distinct()
    b = ids.withColumn("body", reply_body())
    c = F.col("conv_id")
    body = F.col("body")
    reply = (F.when(c % 11 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```")))
             .when(c % 11 == 1, F.lit("I cannot help"))
             .when(c % 11 == 2, F.concat(body, F.lit(" "), body))
             .when(c % 11 == 3, F.lit('{"extraction": [1], "quality_scores": {}}'))
             .when(c % 11 == 4, F.lit("{}"))
             .when(c % 11 == 5, F.substring(body, F.lit(1), F.length(body) - 9))
             .otherwise(F.concat(F.lit(" "), body)))
    return b.select("conv_id", reply.alias("reply"))


def calls_with_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls joined with their raw reply (both keyed by conv_id) plus the transcript hash."""
    return (calls(spark, sf_dir).join(replies(spark, sf_dir), "conv_id")
            .withColumn("transcript_hash", transcript_hash("transcript")))
