"""Manager-facing reads over the call store.

All of these are lazy plans over the stored-call DataFrame; projections of
struct leaves let Parquet read only the needed nested columns, and the equality
filters on plain columns reach the scan as pushed filters.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions import fmt
from ..functions.text import parsed_turns
from .rubric import RUBRIC

SORT_KEYS = {"timestamp": "ts", "telecaller_name": "telecaller_name", "lead_name": "lead_name",
             "duration_sec": "duration_sec", "overall_score": "overall_score"}


def list_projection(calls: DataFrame) -> DataFrame:
    """The list row: stored columns + five analysis fields + four scores (P1, P2); no transcript."""
    a = F.col("analysis")
    qs = a["quality_scores"]
    return calls.select(
        "call_id", "telecaller_id", "telecaller_name", "lead_id", "lead_name", "duration_sec",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "ts", "overall_score",
        a["extraction"]["site_visit_outcome"].alias("site_visit_outcome"),
        a["last_stage_reached"].alias("last_stage_reached"),
        a["recommended_next_action"].alias("recommended_next_action"),
        a["extraction"]["unit_configuration"].alias("unit_configuration"),
        a["extraction"]["timeline"].alias("timeline"),
        *[F.coalesce(qs[d]["score"], F.lit(0)).alias(f"{d}_score") for d in S.DIMENSIONS])


def search_predicate(term: str | None, cols=("transcript", "telecaller_name", "lead_name"),
                     literal: bool = False) -> Column | None:
    """Case-insensitive substring match over the given columns; blank term = no filter.

    By default % and _ in the term act as wildcards, as in the reference's LIKE;
    ``literal=True`` takes them as they are.
    """
    if term is None or not term.strip():
        return None
    t = term.strip().lower()
    pieces = [t] if literal else [p for p in t.split("%") if p]
    if not pieces:
        test = F.isnotnull
    elif len(pieces) == 1 and (literal or "_" not in t):
        test = lambda c: F.contains(c, F.lit(pieces[0]))
    else:
        # each piece at its first place after the one before, for good: a text is gone through once, where a LIKE goes back and forth
        found = ["".join("." if x == "_" else re.escape(x) for x in p) for p in pieces]
        pattern = r"(?s)\A" + "".join(f"(?>.*?{x})" for x in found)
        test = lambda c: F.rlike(c, F.lit(pattern))
    return reduce(lambda a, b: a | b, [test(F.lower(F.col(c))) for c in cols])


def filter_predicate(telecaller: str | None = None, visit: str | None = None, action: str | None = None,
                     min_overall: float = 0.0, min_discovery: float = 0.0) -> Column:
    """Client-side filters: equality on three fields, minimum on two scores, NULL as 0."""
    preds = [F.lit(True)]
    if telecaller:
        preds.append(F.col("telecaller_name") == telecaller)
    if visit:
        preds.append(F.col("site_visit_outcome") == visit)
    if action:
        preds.append(F.col("recommended_next_action") == action)
    preds.append(F.coalesce(F.col("overall_score"), F.lit(0.0)) >= min_overall)
    preds.append(F.coalesce(F.col("discovery_score"), F.lit(0)) >= min_discovery)
    return reduce(lambda a, b: a & b, preds)


def list_calls(calls: DataFrame, search: str | None = None, cap: int | None = None,
               reference_cap: bool = False, **filters) -> DataFrame:
    """Search + filters, newest first, with a cap if the caller passes one (O1, Q9).

    A cap applies after the filters.  ``reference_cap=True`` caps first (the
    reference narrows to the newest 500 on the server and filters those in
    the client); Catalyst keeps the filter above the limit in that case.
    """
    sp = search_predicate(search)
    base = calls.filter(sp) if sp is not None else calls
    rows = list_projection(base)
    order = [F.col("ts").desc(), F.col("call_id")]
    if reference_cap and cap:
        return rows.orderBy(*order).limit(cap).filter(filter_predicate(**filters))
    rows = rows.filter(filter_predicate(**filters))
    return rows.orderBy(*order).limit(cap) if cap else rows


def sort_calls(rows: DataFrame, key: str = "timestamp", descending: bool = True) -> DataFrame:
    """Sort by one of five keys, NULLs last either way; ties by time desc then id (O2, Q10)."""
    c = F.col(SORT_KEYS[key])
    first = c.desc_nulls_last() if descending else c.asc_nulls_last()
    return rows.orderBy(first, F.col("ts").desc(), F.col("call_id"))


def filter_counts(rows: DataFrame, **filters) -> DataFrame:
    """'X of Y calls' in one pass."""
    return rows.agg(F.count_if(filter_predicate(**filters)).alias("shown"), F.count(F.lit(1)).alias("total"))


def telecaller_names(rows: DataFrame) -> DataFrame:
    """Distinct telecaller names, sorted."""
    return rows.select("telecaller_name").distinct().orderBy("telecaller_name")


def lookup(calls: DataFrame, keys: DataFrame, key: str = "call_id") -> DataFrame:
    """Detail rows for many keys at once: a left-semi join (P3); absent keys yield nothing."""
    return calls.join(keys.select(key).distinct(), key, "left_semi")


def newest(rows: DataFrame, n: int, order_by_text: bool = False) -> DataFrame:
    """The newest ``n`` rows by instant (``ts``), or by the text of their time as the reference compares it (``timestamp``, Q1)."""
    return rows.orderBy(F.col("timestamp" if order_by_text else "ts").desc_nulls_last(), F.col("call_id")).limit(n)


def call_detail(calls: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """The detail record per call (T8): title, labels, every field, ``scores`` (score, reason and rubric anchor per
    dimension) and ``turns`` (the transcript's lines).  One projection: the 24 anchors are a literal map, the turns stay in the row."""
    a, ex = F.col("analysis"), F.col("analysis.extraction")
    anchors = F.create_map(*[F.lit(x) for d, (_, texts, _) in RUBRIC.items() for s, text in texts.items() for x in (f"{d}:{s}", text)])

    def score(d: str) -> Column:
        one = a["quality_scores"][d]
        return F.struct(F.lit(d).alias("dimension"), fmt.dimension_label(F.lit(d)).alias("dimension_label"), one["score"].alias("score"),
                        one["reason"].alias("reason"), F.try_element_at(anchors, F.concat(F.lit(f"{d}:"), one["score"].cast("string"))).alias("anchor"))

    return calls.select(
        "call_id", F.concat_ws(" · ", "lead_name", "telecaller_name").alias("title"),
        F.concat_ws(" · ", fmt.fmt_date("ts", zone), fmt.fmt_duration("duration_sec")).alias("subtitle"),
        fmt.quarters_two_decimals("score_quarters").alias("overall_text"), ex["unit_configuration"].alias("unit_configuration"),
        fmt.budget_label(ex["budget_range"]).alias("budget_label"), ex["timeline"].alias("timeline"),
        fmt.locations_label(ex["preferred_locations"]).alias("locations_label"), ex["site_visit_outcome"].alias("site_visit_outcome"),
        a["last_stage_reached"].alias("last_stage_reached"), a["recommended_next_action"].alias("recommended_next_action"),
        a["next_action_reason"].alias("next_action_reason"), a["summary"].alias("summary"),
        F.array(*[score(d) for d in S.DIMENSIONS]).alias("scores"), parsed_turns("transcript").alias("turns"))
