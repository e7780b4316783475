"""Items the spec wishes for but the reference does not implement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col_
from .metrics import field_matches

# Site-visit labels that count as neighbours for partial credit.
ADJACENT_VISITS = [("committed_with_date", "committed_no_date"), ("committed_no_date", "declined")]
# Text of the telecaller's self-introduction in the first Agent line.
INTRO_RE = r"\b([A-Z][a-z]+) here\b"
FIRST_AGENT_RE = r"(?m)^\[[^\]]*\]\s*Agent:\s*(.*)$"
NORMALIZE_RE = r"[\t\n\x0B\f\r \p{P}\p{Z}]+"


def date_score_filter(start: str | None = None, end: str | None = None, min_score: float | None = None,
                      max_score: float | None = None) -> Column:
    """Calls in [start, end) and with the overall score in [min, max].

    On the store the date bounds also prune ``call_date`` partitions.
    """
    p = F.lit(True)
    if start:
        p = p & (F.col("ts") >= F.to_timestamp(F.lit(start))) & (F.col("call_date") >= F.to_date(F.lit(start)))
    if end:
        p = p & (F.col("ts") < F.to_timestamp(F.lit(end))) & (F.col("call_date") <= F.to_date(F.lit(end)))
    if min_score is not None:
        p = p & (F.col("overall_score") >= min_score)
    if max_score is not None:
        p = p & (F.col("overall_score") <= max_score)
    return p


def visit_partial_credit(pairs: DataFrame) -> DataFrame:
    """Exact and adjacent site-visit matches and the credit (exact 1, adjacent 0.5)."""
    p = F.col("pred.extraction.site_visit_outcome")
    g = F.col("gold.extraction.site_visit_outcome")
    adj = F.lit(False)
    for a, b in ADJACENT_VISITS:
        adj = adj | ((p == a) & (g == b)) | ((p == b) & (g == a))
    agg = pairs.agg(F.count(F.lit(1)).alias("total"), F.count_if(p == g).alias("exact"), F.count_if(adj).alias("adjacent"))
    return agg.select(F.col("total").cast("long").alias("total"), F.col("exact").cast("long").alias("exact"),
                      F.col("adjacent").cast("long").alias("adjacent"),
                      ((F.col("exact") * 2 + F.col("adjacent")) / (F.col("total") * 2.0)).alias("credit"))


def normalized_hash(c) -> Column:
    """Content hash insensitive to case, whitespace and punctuation."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(col_(c)), NORMALIZE_RE, ""), 256), 1, 32)


def intro_name(transcript) -> Column:
    """Name the telecaller gives in the first Agent line ('Kavya here ...'), else NULL."""
    first = F.regexp_extract(col_(transcript), FIRST_AGENT_RE, 1)
    name = F.regexp_extract(first, INTRO_RE, 1)
    return F.when(name != "", name)


def disagreements(model: DataFrame, rules: DataFrame, key: str = "call_id") -> DataFrame:
    """Per field, how many calls the rules analyzer and the model disagree on."""
    j = model.select(key, F.col("analysis").alias("pred")).join(rules.select(key, F.col("rules").alias("gold")), key)
    m = field_matches()
    agg = j.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~c).alias(f"d_{f}") for f, c in m.items()])
    stack = ", ".join(f"'{f}', d_{f}" for f in m)
    return agg.select(F.expr(f"stack({len(m)}, {stack}) as (field, disagreements)"), "total").select(
        "field", F.col("disagreements").cast("long").alias("disagreements"), F.col("total").cast("long").alias("total"))
