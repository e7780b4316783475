"""Reply -> analysis -> score for a batch of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.coerce import overall_score, score_quarters, validate_replies


def analyze(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Validate each reply and add overall_score / score_quarters (NULL unless ok)."""
    v = validate_replies(df, reply)
    return v.withColumns({"score_quarters": score_quarters("analysis"), "overall_score": overall_score("analysis")})


def flat_columns(analysis: str = "analysis", locations_sep: str = "|") -> list[Column]:
    """The analysis struct as scalar columns (list view + oracle comparisons)."""
    a = F.col(analysis)
    ex = a["extraction"]
    cols = [
        ex["unit_configuration"].alias("unit_configuration"),
        ex["budget_range"]["min_lakhs"].alias("budget_min"),
        ex["budget_range"]["max_lakhs"].alias("budget_max"),
        ex["timeline"].alias("timeline"),
        F.array_join(ex["preferred_locations"], locations_sep).alias("preferred_locations"),
        ex["site_visit_outcome"].alias("site_visit_outcome"),
        a["last_stage_reached"].alias("last_stage_reached"),
        a["recommended_next_action"].alias("recommended_next_action"),
        a["next_action_reason"].alias("next_action_reason"),
        a["summary"].alias("summary"),
    ]
    for d in S.DIMENSIONS:
        cols.append(a["quality_scores"][d]["score"].alias(f"{d}_score"))
        cols.append(a["quality_scores"][d]["reason"].alias(f"{d}_reason"))
    return cols


def analysis_json(analysis) -> Column:
    """The analysis as the reference's JSON text: the budget union re-expanded.

    The typed struct holds "not_discussed" as a NULL budget; the export writes
    the string back in that case and the {min_lakhs, max_lakhs} object otherwise.
    """
    a = F.col(analysis) if isinstance(analysis, str) else analysis
    ex = a["extraction"]
    budget = F.when(ex["budget_range"].isNull(), F.lit('"not_discussed"')).otherwise(F.to_json(ex["budget_range"]))
    extraction = F.concat(
        F.lit('{"unit_configuration":'), _json_str(ex["unit_configuration"]),
        F.lit(',"budget_range":'), budget,
        F.lit(',"timeline":'), _json_str(ex["timeline"]),
        F.lit(',"preferred_locations":'), F.to_json(ex["preferred_locations"]),
        F.lit(',"site_visit_outcome":'), _json_str(ex["site_visit_outcome"]),
        F.lit("}"))
    return F.concat(
        F.lit('{"extraction":'), extraction,
        F.lit(',"quality_scores":'), F.to_json(a["quality_scores"]),
        F.lit(',"last_stage_reached":'), _json_str(a["last_stage_reached"]),
        F.lit(',"recommended_next_action":'), _json_str(a["recommended_next_action"]),
        F.lit(',"next_action_reason":'), _json_str(a["next_action_reason"]),
        F.lit(',"summary":'), _json_str(a["summary"]),
        F.lit("}"))


def _json_str(c: Column) -> Column:
    """A string value as a JSON string literal (quoted and escaped)."""
    j = F.to_json(F.array(c))
    return j.substr(F.lit(2), F.length(j) - 2)


def response_record(df: DataFrame) -> DataFrame:
    """{call_id, cached, ...analysis} as one flat record per call."""
    return df.select("call_id", "cached", "analysis.*")
