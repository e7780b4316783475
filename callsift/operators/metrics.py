"""Telemetry over the attempt log and accuracy against labels.

The reference keeps counters in process memory; here they are aggregations
over the persisted attempt log, so they survive restarts and cover every
executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions.text import transcript_hash
from ..session import kept

# ------------------------------------------------------------------ A3 percentiles


def latency_counts(outcomes: DataFrame) -> DataFrame:
    """latency_ms, is_error, n: how often each occurred.  Tables of several rounds or runs may be put together."""
    return outcomes.groupBy("latency_ms", "is_error").agg(F.count(F.lit(1)).alias("n"))


def rank_rule_percentiles(df: DataFrame, value: str, qs: list[float], weight: str | None = None) -> DataFrame:
    """(q, value_at_q) with the reference rule: sorted[min(int(q*n), n-1)] (Q7).

    ``weight`` names a column that says how often a row's value occurred (a table of counts).
    One scan: counts per distinct value (combined map-side) are dealt by range of value
    and written once.  The ranges' totals, one row each, give every wanted position its
    range; the running count then orders the distinct values within those ranges only.
    The one window without a partition runs over the totals (one row per shuffle partition).
    """
    times = F.col(weight) if weight else F.lit(1)
    counts = (df.select(F.col(value).alias("_v"), times.alias("_w")).filter(F.col("_v").isNotNull()).groupBy("_v").agg(F.sum("_w").alias("_c"))
              .repartitionByRange("_v").withColumn("_p", F.spark_partition_id()))
    counts = kept(counts, "percentiles")
    upto = Window.orderBy("_p")
    ranges = counts.groupBy("_p").agg(F.sum("_c").alias("_t")).withColumn("_upto", F.sum("_t").over(upto))
    ranges = ranges.withColumn("_n", F.sum("_t").over(Window.partitionBy()))
    at = F.least(F.floor(F.col("q") * F.col("_n")), F.col("_n") - 1)
    wanted = (ranges.withColumn("q", F.explode(F.array(*[F.lit(q) for q in qs]))).withColumn("_at", at)
              .filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_t")))
              .select("_p", "q", (F.col("_at") - F.col("_upto") + F.col("_t")).alias("_local")))
    inside = counts.join(F.broadcast(wanted), "_p")  # one row per wanted q
    c = inside.withColumn("_upto", F.sum("_c").over(Window.partitionBy("q").orderBy("_v")))
    return c.filter((F.col("_local") < F.col("_upto")) & (F.col("_local") >= F.col("_upto") - F.col("_c"))).select(
        "q", F.col("_v").alias("value"))


# ------------------------------------------------------------------ A2 A4 telemetry
def telemetry(counts: DataFrame, stored_count: DataFrame, provider: str = "replay", model: str = "none",
              price_per_call: float = 0.0) -> DataFrame:
    """One row: llm_calls, errors, p50/p95/avg ms (rounded half-even to 0 decimals), store size, cost.

    counts: ``latency_counts`` of any number of rounds (latency_ms is NULL when no reply came back); no attempt is read.
    stored_count: a 1-row DataFrame with column ``n`` (the store's row count).
    """
    replied = F.when(F.col("latency_ms").isNotNull(), F.col("n"))
    agg = counts.agg(F.coalesce(F.sum(replied), F.lit(0)).cast("double").alias("llm_calls"),
                     F.coalesce(F.sum(F.when(F.col("is_error"), F.col("n"))), F.lit(0)).cast("double").alias("errors"),
                     F.sum(F.col("latency_ms") * F.col("n")).alias("total"))
    parts = [
        agg.select(F.expr("stack(3, 'llm_calls', llm_calls, 'errors', errors, 'total', total) as (metric, value)")),
        rank_rule_percentiles(counts, "latency_ms", [0.5, 0.95], "n").select(
            F.when(F.col("q") == 0.5, F.lit("p50")).otherwise(F.lit("p95")).alias("metric"), "value"),
        stored_count.select(F.lit("n").alias("metric"), F.col("n").cast("double").alias("value")),
    ]
    # every part is a handful of single-value rows: union them and pivot with one aggregate
    long = parts[0].unionByName(parts[1]).unionByName(parts[2])
    m = {k: F.max(F.when(F.col("metric") == k, F.col("value"))) for k in ("llm_calls", "errors", "total", "p50", "p95", "n")}
    w = long.agg(*[c.alias(k) for k, c in m.items()])
    calls = F.col("llm_calls").cast("long")
    return w.select(
        calls.alias("llm_calls"), F.col("errors").cast("long").alias("errors"),
        F.bround(F.coalesce(F.col("p50"), F.lit(0.0)), 0).alias("p50_ms"),
        F.bround(F.coalesce(F.col("p95"), F.lit(0.0)), 0).alias("p95_ms"),
        F.when(calls > 0, F.bround(F.col("total") / calls, 0)).otherwise(F.lit(0.0)).alias("avg_ms"),
        F.col("n").cast("long").alias("total_calls_in_db"),
        F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        (calls * F.lit(price_per_call)).cast("double").alias("estimated_cost_usd"))


# ------------------------------------------------------------------ V12 A5 A6 A7
FIELDS = ["unit_configuration", "budget_range", "timeline", "preferred_locations", "site_visit_outcome",
          "last_stage_reached", "recommended_next_action"]


def _lower_sorted(c: Column) -> Column:
    return F.array_sort(F.transform(c, lambda x: F.lower(x)))


def pair_labels(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """Each label with its prediction (J4): that of its call_id, else that of the first call with its transcript.

    preds: call_id, transcript_hash, pred, parse_status; labels: call_id, transcript, label, budget_given.
    A label that meets neither has the status ``no_prediction``.
    """
    keyed = labels.withColumn("transcript_hash", transcript_hash("transcript"))
    # labels without an id are spread by their hash; no call_id begins with a blank
    keyed = keyed.withColumn("_key", F.coalesce("call_id", F.concat(F.lit(" "), "transcript_hash")))
    own = preds.select(F.col("call_id").alias("_key"), F.col("call_id").alias("_own"))
    same = preds.groupBy("transcript_hash").agg(F.min("call_id").alias("_same"))
    # ids first, so that the predictions are read and moved once
    found = (keyed.join(own, "_key", "left").join(same, "transcript_hash", "left")
             .select("call_id", "transcript_hash", F.col("label").alias("gold"), "budget_given",
                     F.coalesce("_own", "_same", "_key").alias("_pair")))
    answers = preds.select(F.col("call_id").alias("_pair"), "pred", "parse_status")
    return found.join(answers, "_pair", "left").drop("_pair").fillna("no_prediction", ["parse_status"])


def field_matches(pred: str = "pred", gold: str = "gold", given: str | None = None) -> dict[str, Column]:
    """Per field: does the prediction equal the gold label (V12)?

    Lists compare as case-insensitive sorted multisets (NULL prediction = [],
    missing gold list = [], NULL gold list never matches); the budget union
    compares both bounds (NULL = not discussed on both sides); scalars compare
    exactly and a missing gold scalar never matches.  ``given`` names a boolean
    column that is false where the gold budget is missing, which never matches.
    """
    p, g = F.col(pred), F.col(gold)
    pe, ge = p["extraction"], g["extraction"]
    out = {}
    for f in ("unit_configuration", "timeline", "site_visit_outcome"):
        out[f] = F.coalesce(pe[f] == ge[f], F.lit(False))
    pl = _lower_sorted(F.coalesce(pe["preferred_locations"], F.array().cast("array<string>")))
    gl = _lower_sorted(F.coalesce(ge["preferred_locations"], F.array().cast("array<string>")))
    out["preferred_locations"] = F.coalesce(pl == gl, F.lit(False))
    out["budget_range"] = pe["budget_range"].eqNullSafe(ge["budget_range"])
    if given:
        out["budget_range"] = out["budget_range"] & F.col(given)
    for f in ("last_stage_reached", "recommended_next_action"):
        out[f] = F.coalesce(p[f] == g[f], F.lit(False))
    return out


def field_accuracy(pairs: DataFrame) -> DataFrame:
    """(field, correct, total, pct) over prediction/gold pairs that produced output (A5, Q17)."""
    m = field_matches(given="budget_given" if "budget_given" in pairs.columns else None)
    agg = pairs.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"c_{f}") for f, c in m.items()])
    stack = ", ".join(f"'{f}', c_{f}" for f in FIELDS)
    long = agg.select("total", F.expr(f"stack({len(FIELDS)}, {stack}) as (field, correct)"))
    return long.select("field", F.col("correct").cast("long").alias("correct"), F.col("total").cast("long").alias("total"),
                       F.when(F.col("total") > 0, F.bround(F.col("correct") * 100.0 / F.col("total"), 1)).alias("pct"))


def dimension_accuracy(pairs: DataFrame) -> DataFrame:
    """(dimension, exact, adjacent, total): rows without a gold score are skipped but stay in total."""
    cols = [F.count(F.lit(1)).alias("total")]
    for d in S.DIMENSIONS:
        p = F.col("pred")["quality_scores"][d]["score"]
        g = F.col("gold")["quality_scores"][d]["score"]
        cols += [F.count_if(g.isNotNull() & (p == g)).alias(f"e_{d}"),
                 F.count_if(g.isNotNull() & (F.abs(p - g) <= 1)).alias(f"a_{d}")]
    agg = pairs.agg(*cols)
    stack = ", ".join(f"'{d}', e_{d}, a_{d}" for d in S.DIMENSIONS)
    return agg.select(F.expr(f"stack({len(S.DIMENSIONS)}, {stack}) as (dimension, exact, adjacent)"), "total").select(
        "dimension", F.col("exact").cast("long").alias("exact"), F.col("adjacent").cast("long").alias("adjacent"),
        F.col("total").cast("long").alias("total"))
