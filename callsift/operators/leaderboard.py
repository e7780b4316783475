"""Telecaller leaderboard.

One partial + final hash aggregation on (telecaller_id, telecaller_name):
map-side combine keeps the shuffle to at most 22 rows per telecaller per task even
when one telecaller holds a third of all calls.  Averages are computed on the
integer quarter points so the two-decimal rounding is exact (half up, as the
reference's SQLite ROUND does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import kept
from .ranking import bounded_key_rank


def leaderboard(calls: DataFrame) -> DataFrame:
    """calls: telecaller_id, telecaller_name, score_quarters (NULL allowed, counted but not averaged)."""
    counts = calls.groupBy("telecaller_id", "telecaller_name", "score_quarters").agg(F.count(F.lit(1)).alias("calls"))
    # read twice by the rank: written, so that what is upstream (the validation of replies) runs once
    return from_score_counts(kept(counts, "scores"))


def from_score_counts(counts: DataFrame) -> DataFrame:
    """The leaderboard of mergeable counts: telecaller_id, telecaller_name, score_quarters, calls.

    Counts of disjoint sets of calls may be put together (rows may repeat; counts may be negative to take calls away);
    a score holds 0 to 20 quarters, so a telecaller has at most 22 rows once they are added up.
    """
    c = counts.groupBy("telecaller_id", "telecaller_name", "score_quarters").agg(F.sum("calls").alias("calls")).where("calls <> 0")
    scored = F.col("score_quarters").isNotNull()
    g = c.groupBy("telecaller_id", "telecaller_name").agg(
        F.sum("calls").cast("long").alias("calls"),
        F.sum(F.col("score_quarters") * F.col("calls")).alias("_sq"),
        F.sum(F.when(scored, F.col("calls"))).alias("_n"),
        F.min("score_quarters").alias("_minq"),
        F.max("score_quarters").alias("_maxq"))
    hundredths = F.expr("(200 * _sq + 4 * _n) div (8 * _n)")
    g = g.select(
        "telecaller_id", "telecaller_name", "calls",
        F.when(F.col("_n") > 0, hundredths).alias("_avg_h"),
        (F.col("_minq") / 4.0).alias("min_score"),
        (F.col("_maxq") / 4.0).alias("max_score"))
    ranked = bounded_key_rank(g, "_avg_h", [F.col("telecaller_id"), F.col("telecaller_name")])
    return ranked.select(
        "rank", "telecaller_id", "telecaller_name", "calls",
        (F.col("_avg_h") / 100.0).alias("avg_score"), "min_score", "max_score",
        (F.col("rank") == 1).alias("is_top"),
        ((F.col("rank") == F.col("_total")) & (F.col("_total") > 1)).alias("is_bottom"))
