"""DuckDB SQL oracles, one per registered query (same column names and types)."""

from __future__ import annotations

from .. import schema as S
from .oracle_base import hash_sql, with_ctes
from .oracle_validate import validated_cte

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def _validated_with(*names: str, extra: list[str] | None = None) -> str:
    return with_ctes(["calls", "replies", *names], validated_cte("replies") + list(extra or []))


_FLAT = ["unit_configuration", "budget_min", "budget_max", "timeline", "preferred_locations",
         "site_visit_outcome", "last_stage_reached", "recommended_next_action", "next_action_reason", "summary"]
for _d in S.DIMENSIONS:
    _FLAT += [f"{_d}_score", f"{_d}_reason"]


def _flat_select(ok_only: bool) -> str:
    cols = []
    for c in _FLAT:
        expr = "array_to_string(preferred_locations, '|')" if c == "preferred_locations" else c
        cols.append(f"CASE WHEN parse_status = 'ok' THEN {expr} END AS {c}")
    return ", ".join(cols)


# stored calls: calls whose reply validated, with hash and quarter points
_STORED = ("stored AS (SELECT c.*, " + hash_sql("c.transcript") + " AS transcript_hash, "
           "v.discovery_score + v.pitch_score + v.objection_handling_score + v.next_step_score AS score_quarters "
           "FROM calls c JOIN validated v ON v.conv_id = c.conv_id WHERE v.parse_status = 'ok')")


def _leaderboard_sql(src: str) -> str:
    return f"""lb AS (
  SELECT telecaller_id, telecaller_name, CAST(count(*) AS BIGINT) AS calls,
         CASE WHEN count(score_quarters) > 0 THEN
           CAST((200 * sum(score_quarters) + 4 * count(score_quarters)) // (8 * count(score_quarters)) AS DOUBLE) / 100 END AS avg_score,
         min(score_quarters) / 4.0 AS min_score, max(score_quarters) / 4.0 AS max_score
  FROM {src} GROUP BY telecaller_id, telecaller_name),
ranked AS (
  SELECT CAST(row_number() OVER (ORDER BY avg_score DESC NULLS LAST, telecaller_id, telecaller_name) AS INTEGER) AS rank,
         *, count(*) OVER () AS _total FROM lb)
SELECT rank, telecaller_id, telecaller_name, calls, avg_score, CAST(min_score AS DOUBLE) AS min_score,
       CAST(max_score AS DOUBLE) AS max_score, rank = 1 AS is_top, rank = _total AND _total > 1 AS is_bottom
FROM ranked"""


oracle("leaderboard", _validated_with(extra=[_STORED]).rstrip("\n") + ",\n" + _leaderboard_sql("stored"))

oracle("leaderboard_large", "WITH ev AS (SELECT 'U' || CAST(user_id AS VARCHAR) AS telecaller_id, "
       "'user ' || CAST(user_id AS VARCHAR) AS telecaller_name, "
       "CAST(json_extract_string(props, '$.k') AS INTEGER) % 21 AS score_quarters FROM events),\n"
       + _leaderboard_sql("ev"))

oracle("json_status", _validated_with() + "SELECT conv_id, parse_status FROM validated")

oracle("json_cut", _validated_with() +
       "SELECT conv_id, _found AS found, substr(_arr, 2, length(_arr) - 2) AS cut FROM validated")

oracle("analysis_validate", _validated_with() + f"SELECT conv_id, parse_status, {_flat_select(False)} FROM validated")

oracle("enum_coerce", _validated_with() + "SELECT conv_id, unit_configuration, timeline, site_visit_outcome, "
       "last_stage_reached, recommended_next_action FROM validated WHERE parse_status = 'ok'")

oracle("budget_coerce", _validated_with() + "SELECT conv_id, CASE WHEN parse_status = 'ok' THEN budget_min END AS budget_min, "
       "budget_max FROM validated WHERE parse_status = 'ok'")

oracle("locations_clean", _validated_with() + "SELECT conv_id, array_to_string(preferred_locations, '|') AS preferred_locations "
       "FROM validated WHERE parse_status = 'ok'")

oracle("reason_truncate", _validated_with() + "SELECT conv_id, discovery_reason, pitch_reason, objection_handling_reason, "
       "next_step_reason, next_action_reason, summary FROM validated WHERE parse_status = 'ok'")

oracle("score_scale", _validated_with() + "SELECT conv_id, discovery_score, pitch_score, objection_handling_score, next_step_score, "
       "discovery_score + pitch_score + objection_handling_score + next_step_score AS score_quarters, "
       "CAST(discovery_score + pitch_score + objection_handling_score + next_step_score AS DOUBLE) / 4 AS overall_score "
       "FROM validated WHERE parse_status = 'ok'")

_RAW = "CAST((CAST(json_extract_string(props, '$.k') AS INTEGER) - 10) / 4.0 AS DOUBLE)"
oracle("score_coerce", f"SELECT event_id, CAST({_RAW} AS VARCHAR) AS raw, "
       f"CAST(least(5.0, greatest(0.0, round_even({_RAW}, 0))) AS INTEGER) AS score FROM events")

_TURN = r"^(\[(\d+):(\d+)-(\d+):(\d+)\])\s*(Agent|Lead):\s*(.*)$"
oracle("turns_parse", with_ctes(["calls"], [
    "ln AS (SELECT call_id, unnest(string_split(transcript, chr(10))) AS line, "
    "generate_subscripts(string_split(transcript, chr(10)), 1) - 1 AS turn_no FROM calls)"]) +
    f"""SELECT call_id, CAST(turn_no AS INTEGER) AS turn_no, line, regexp_matches(line, '{_TURN}') AS parsed,
  CASE WHEN regexp_matches(line, '{_TURN}') THEN regexp_extract(line, '{_TURN}', 1) END AS stamp,
  CASE WHEN regexp_matches(line, '{_TURN}') THEN CAST(regexp_extract(line, '{_TURN}', 2) AS INTEGER) * 60 + CAST(regexp_extract(line, '{_TURN}', 3) AS INTEGER) END AS start_sec,
  CASE WHEN regexp_matches(line, '{_TURN}') THEN CAST(regexp_extract(line, '{_TURN}', 4) AS INTEGER) * 60 + CAST(regexp_extract(line, '{_TURN}', 5) AS INTEGER) END AS end_sec,
  CASE WHEN regexp_matches(line, '{_TURN}') THEN regexp_extract(line, '{_TURN}', 6) END AS speaker,
  CASE WHEN regexp_matches(line, '{_TURN}') THEN regexp_extract(line, '{_TURN}', 7) END AS utterance
FROM ln""")

_STAMP = r"\[(\d+):(\d+)-(\d+):(\d+)\]"
oracle("call_duration", with_ctes(["calls"], [
    f"d AS (SELECT call_id, duration_sec, coalesce(CAST(regexp_extract_all(transcript, '{_STAMP}', 3)[-1] AS BIGINT) * 60 "
    f"+ CAST(regexp_extract_all(transcript, '{_STAMP}', 4)[-1] AS BIGINT), 0) AS duration_est FROM calls)"]) +
    "SELECT call_id, duration_sec, duration_est, CAST(duration_est // 60 AS VARCHAR) || ':' || "
    "lpad(CAST(duration_est % 60 AS VARCHAR), 2, '0') AS duration_text FROM d")

oracle("transcript_hash", with_ctes(["calls"]) + f"SELECT call_id, {hash_sql('transcript')} AS transcript_hash FROM calls")


from . import oracles_ops  # noqa: E402,F401  (registers the remaining oracles)
from . import oracles_rules  # noqa: E402,F401
from . import oracles_store  # noqa: E402,F401
