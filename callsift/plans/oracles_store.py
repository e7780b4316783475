"""DuckDB oracles for the queries over the committed store, typed edits and detail records."""

from __future__ import annotations

from .. import schema as S
from ..operators import rubric as R
from ..operators import store as ST
from ..operators.views import SORT_KEYS
from .oracle_base import hash_sql, pad_sql, strip_sql, with_ctes
from .oracle_validate import jt, pystr, to_float, validated_cte
from .oracles import ORACLES, _leaderboard_sql, oracle
from .oracles_ops import INGEST_TS, N_CONV, SUMQ, jsnum, q, ts_text, with_stored
from .oracles_rules import _rules_sql

# ----------------------------------------------------------------- store
#: Each call with the quarter points of its own reply (q1) and of the next conversation's (q2), NULL where not valid.
_TWO = f"""two AS MATERIALIZED (
  SELECT c.*, v.q AS q1, w.q AS q2, v.discovery_score AS d1, w.discovery_score AS d2 FROM calls c
  LEFT JOIN (SELECT conv_id, {SUMQ.replace('v.', '')} AS q, discovery_score FROM validated WHERE parse_status = 'ok') v ON v.conv_id = c.conv_id
  LEFT JOIN (SELECT conv_id, {SUMQ.replace('v.', '')} AS q, discovery_score FROM validated WHERE parse_status = 'ok') w ON w.conv_id = c.conv_id + 1)"""


def _with_two(*extra: str) -> str:
    return with_ctes(["calls", "replies"], validated_cte("replies") + [_TWO, *extra])


_RESENT = "(conv_id % 5 < 4 AND conv_id % 2 = 0 AND q2 IS NOT NULL)"
oracle("standing_leaderboard", _with_two(
    f"last AS (SELECT telecaller_id, telecaller_name, CASE WHEN {_RESENT} THEN q2 ELSE q1 END AS score_quarters FROM two "
    f"WHERE q1 IS NOT NULL OR {_RESENT})").rstrip("\n") + ",\n" + _leaderboard_sql("last"))

oracle("change_feed", _with_two(
    "s AS (SELECT *, conv_id % 2 = 0 AND q1 IS NOT NULL AS one, conv_id % 3 = 0 AND q2 IS NOT NULL AS two FROM two)") +
    """SELECT 1 AS version, call_id, 'insert' AS change, q1 AS score_quarters FROM s WHERE one
UNION ALL SELECT 2, call_id, CASE WHEN one THEN 'update' ELSE 'insert' END, q2 FROM s WHERE two
UNION ALL SELECT 3, call_id, 'update', CASE WHEN two THEN q2 - d2 ELSE q1 - d1 END + 5 FROM s WHERE conv_id % 7 = 0 AND (one OR two)""")

oracle("store_cache_hits", ORACLES["cache_hits"])

oracle("response_cached", with_stored("even AS (SELECT transcript_hash, min_by(call_id, (ts, call_id)) AS cached_call_id FROM stored "
                                      "WHERE conv_id % 2 = 0 GROUP BY transcript_hash)") +
       """SELECT coalesce(e.cached_call_id, s.call_id) AS call_id, e.cached_call_id IS NOT NULL AS cached, coalesce(k.timeline, s.timeline) AS timeline,
  CASE WHEN k.call_id IS NULL THEN s.discovery_score ELSE k.discovery_score END AS discovery_score,
  coalesce(k.last_stage_reached, s.last_stage_reached) AS last_stage_reached, coalesce(k.summary, s.summary) AS summary
FROM stored s LEFT JOIN even e ON e.transcript_hash = s.transcript_hash LEFT JOIN stored k ON k.call_id = e.cached_call_id""")

# a call sent again keeps its transcript and takes the hash of the new one
oracle("hash_consistency", _with_two() + f"""SELECT call_id, {hash_sql("transcript || chr(10) || '[resent]'")} AS transcript_hash
FROM two WHERE conv_id % 2 = 0 AND q1 IS NOT NULL AND conv_id % 3 = 0 AND q2 IS NOT NULL""")

# ----------------------------------------------------------------- typed edits
_FORM, _KIND = "((event_id // 6) % 7)", "(event_id % 6)"
_N = "CAST(event_id % 50 + 1 AS VARCHAR)"
_TYPED = [
    f"""te AS MATERIALIZED (SELECT e.event_id, e.ts, 'CALL_' || {pad_sql('event_id % ' + N_CONV, 6)} AS call_id,
  CASE WHEN {_KIND} IN (0, 5) THEN '{ST.BUDGET}' WHEN {_KIND} = 1 THEN '{ST.LOCATIONS}' WHEN {_KIND} = 2 THEN 'quality_scores.pitch.reason'
       WHEN {_KIND} = 3 THEN 'next_action_reason' ELSE 'summary' END AS field,
  CASE WHEN {_KIND} IN (0, 5) THEN CASE {_FORM} WHEN 0 THEN '{{"min_lakhs": ' || {_N} || ', "max_lakhs": 60}}' WHEN 1 THEN '{{"min_lakhs": 90, "max_lakhs": ' || {_N} || '}}'
         WHEN 2 THEN '{{"min_lakhs": " ' || {_N} || '.5"}}' WHEN 3 THEN ' not_discussed' WHEN 4 THEN '{{"min_lakhs": "abc"}}'
         WHEN 5 THEN '{{"min_lakhs": 0, "max_lakhs": 0}}' ELSE 'cheap' END
       WHEN {_KIND} = 1 THEN CASE {_FORM} % 3 WHEN 0 THEN '["OMR", " ' || event_type || ' ", "", 7]' WHEN 1 THEN 'OMR' ELSE '[]' END
       ELSE d.text END AS value
  FROM events e LEFT JOIN documents d ON d.doc_id = e.event_id % (SELECT max(doc_id) + 1 FROM documents))""",
    "tj AS (SELECT *, CASE WHEN field NOT LIKE 'extraction.%' THEN NULL WHEN json_valid(value) THEN value::JSON END AS j FROM te)",
    f"""tb AS (SELECT *, CASE WHEN json_extract(j, '$.min_lakhs') IS NULL THEN 0.0::DOUBLE ELSE {to_float("json_extract(j, '$.min_lakhs')")} END AS lo,
  {to_float("json_extract(j, '$.max_lakhs')")} AS hi0 FROM tj)""",
    "tc AS (SELECT *, CASE WHEN json_extract(j, '$.max_lakhs') IS NULL THEN lo ELSE hi0 END AS hi FROM tb)",
    f"""tk AS MATERIALIZED (SELECT *, call_id IN (SELECT call_id FROM stored) AS known, coalesce(CASE
    WHEN field = '{ST.BUDGET}' THEN {strip_sql('value')} = 'not_discussed' OR ({jt('j')} = 'OBJECT' AND lo IS NOT NULL AND hi IS NOT NULL AND NOT isnan(lo) AND NOT isnan(hi))
    WHEN field = '{ST.LOCATIONS}' THEN {jt('j')} = 'ARRAY' ELSE value IS NOT NULL END, false) AS ok FROM tc)""",
    "tl AS MATERIALIZED (SELECT * FROM tk WHERE ok AND known QUALIFY row_number() OVER (PARTITION BY call_id, field ORDER BY ts DESC, event_id DESC) = 1)",
    f"tlb AS (SELECT * FROM tl WHERE field = '{ST.BUDGET}')",
    f"tll AS (SELECT *, list_filter(list_transform(json_extract(j, '$[*]'), lambda x: {strip_sql(pystr('x'))}), lambda x: x <> '') AS places FROM tl WHERE field = '{ST.LOCATIONS}')",
]
_GOOD = "(b.lo > 0 OR b.hi > 0)"


def _text(field: str, old: str, most: int) -> tuple[str, str]:
    return (f"LEFT JOIN tl {old}_t ON {old}_t.call_id = s.call_id AND {old}_t.field = '{field}'",
            f"CASE WHEN {old}_t.call_id IS NOT NULL THEN substr({old}_t.value, 1, {most}) ELSE s.{old} END")


_tp, _cp = _text("quality_scores.pitch.reason", "pitch_reason", S.REASON_MAX)
_ta, _ca = _text("next_action_reason", "next_action_reason", S.ACTION_REASON_MAX)
_ts, _cs = _text("summary", "summary", S.SUMMARY_MAX)
oracle("apply_typed_edits", with_stored(*_TYPED) + f"""SELECT s.call_id,
  CASE WHEN b.call_id IS NULL THEN s.budget_min WHEN b.j IS NOT NULL AND {_GOOD} THEN least(b.lo, b.hi) END AS budget_min,
  CASE WHEN b.call_id IS NULL THEN s.budget_max WHEN b.j IS NOT NULL AND {_GOOD} THEN greatest(b.lo, b.hi) END AS budget_max,
  array_to_string(CASE WHEN l.call_id IS NULL THEN s.preferred_locations ELSE l.places END, '|') AS locations,
  CAST(length({_cp}) AS INTEGER) AS pitch_chars, md5({_cp}) AS pitch_md5, md5({_ca}) AS action_md5,
  CAST(length({_cs}) AS INTEGER) AS summary_chars, md5({_cs}) AS summary_md5, s.overall_score,
  s.call_id IN (SELECT call_id FROM tl) AS edited
FROM stored s LEFT JOIN tlb b ON b.call_id = s.call_id LEFT JOIN tll l ON l.call_id = s.call_id {_tp} {_ta} {_ts}""")

oracle("typed_edit_quarantine", with_stored(*_TYPED) + """SELECT event_id AS edit_id, call_id, field,
  CASE WHEN NOT known THEN 'call not found' ELSE 'invalid field or value' END AS reason FROM tk WHERE NOT known OR NOT ok""")

# ----------------------------------------------------------------- detail, lists, ingest
_local = "(ts + INTERVAL 330 MINUTE)"
_TURN = r"^(\[(\d+):(\d+)-(\d+):(\d+)\])\s*(Agent|Lead):\s*(.*)$"
_rub = ", ".join(f"({q(d)}, {s}, {q(a)})" for d, _o, s, a, _desc, _n in R.rubric_rows())
_anchor = " || '|' || ".join(f"(SELECT anchor FROM rub WHERE dimension = '{d}' AND score = s.{d}_score)" for d in S.DIMENSIONS)
oracle("call_detail", with_stored(
    f"rub(dimension, score, anchor) AS (VALUES {_rub})",
    "ln AS (SELECT call_id, unnest(string_split(transcript, chr(10))) AS line, generate_subscripts(string_split(transcript, chr(10)), 1) AS i FROM stored)",
    f"tn AS (SELECT call_id, count(*) FILTER (WHERE regexp_matches(line, '{_TURN}')) AS parsed, string_agg(CASE WHEN regexp_matches(line, '{_TURN}') THEN "
    f"regexp_extract(line, '{_TURN}', 1) || '~' || regexp_extract(line, '{_TURN}', 6) || '~' || regexp_extract(line, '{_TURN}', 7) ELSE '' END, chr(10) ORDER BY i) AS text "
    "FROM ln GROUP BY call_id)") +
    f"""SELECT s.call_id, lead_name || ' · ' || telecaller_name AS title,
  strftime({_local}, '%-d %b, %I:%M ') || lower(strftime({_local}, '%p')) || ' · ' || CAST(duration_sec // 60 AS VARCHAR) || ':' || lpad(CAST(duration_sec % 60 AS VARCHAR), 2, '0') AS subtitle,
  CAST((score_quarters * 25) // 100 AS VARCHAR) || '.' || lpad(CAST((score_quarters * 25) % 100 AS VARCHAR), 2, '0') AS overall_text, unit_configuration,
  CASE WHEN budget_min IS NULL THEN 'Not discussed' WHEN budget_min = budget_max THEN {jsnum('budget_min')} || ' L'
       ELSE {jsnum('budget_min')} || '–' || {jsnum('budget_max')} || ' L' END AS budget_label, timeline,
  CASE WHEN len(preferred_locations) > 0 THEN array_to_string(preferred_locations, ', ') ELSE 'None' END AS locations_label, site_visit_outcome,
  last_stage_reached, recommended_next_action, next_action_reason, summary,
  '{"|".join(d.replace("_", " ") for d in S.DIMENSIONS)}' AS dimensions,
  {" || '|' || ".join(f"CAST({d}_score AS VARCHAR)" for d in S.DIMENSIONS)} AS scores, {" || '|' || ".join(f"{d}_reason" for d in S.DIMENSIONS)} AS reasons,
  {_anchor} AS anchors, CAST(tn.parsed AS INTEGER) AS parsed_turns, md5(tn.text) AS turns_md5
FROM stored s JOIN tn ON tn.call_id = s.call_id""")

_pages = " UNION ALL ".join(
    f"""SELECT '{key}' AS key, {str(down).lower()} AS descending, CAST(row_number() OVER (ORDER BY {c} {'DESC' if down else 'ASC'} NULLS LAST, ts DESC, call_id) AS INTEGER) AS place, call_id
FROM stored QUALIFY place <= 50""" for key, c in SORT_KEYS.items() for down in (True, False))
oracle("list_sorted_all", with_stored() + _pages)

_name = "telecaller_name = (SELECT min(telecaller_name) FROM stored)"
oracle("list_filters", with_stored() + " UNION ALL ".join(
    f"SELECT '{label}' AS filter, call_id, telecaller_name, recommended_next_action FROM stored WHERE {cond}" for label, cond in
    (("telecaller", _name), ("action", "recommended_next_action = 'mark_cold'"), ("both", _name + " AND recommended_next_action = 'mark_cold'"))))

_ZONED = """zoned AS (SELECT *, strftime(ts + to_minutes(CAST([330, 0, -480][conv_id % 3 + 1] AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || ['+05:30', 'Z', '-08:00'][conv_id % 3 + 1] AS timestamp FROM calls)"""
#: Instants of the texts: to the second.
_INSTANT = "date_trunc('second', ts)"
oracle("list_text_order", with_ctes(["calls"], [_ZONED]) + f"""SELECT by_text, call_id, timestamp FROM (
  SELECT true AS by_text, call_id, timestamp FROM zoned QUALIFY row_number() OVER (ORDER BY timestamp DESC, call_id) <= 25
  UNION ALL SELECT false, call_id, timestamp FROM zoned QUALIFY row_number() OVER (ORDER BY {_INSTANT} DESC, call_id) <= 25)""")

# a cut line has lost the end of its transcript: the row is malformed and has kept no field after it
oracle("calls_jsonl", with_ctes(["calls"]) + f"""SELECT CASE WHEN cut THEN NULL ELSE call_id END AS call_id,
  CASE WHEN status = 'ok' THEN {ts_text('ts')} END AS ts, CASE WHEN status = 'ok' THEN md5(transcript) END AS transcript_md5, status
FROM (SELECT *, conv_id % 8 = 5 AS cut, CASE WHEN conv_id % 8 = 5 THEN 'malformed' WHEN conv_id % 9 = 4 THEN 'no time' ELSE 'ok' END AS status FROM calls)""")

_long = {"discovery": S.REASON_MAX, "next_step": S.REASON_MAX, "action": S.ACTION_REASON_MAX, "summary": S.SUMMARY_MAX}
oracle("reason_truncate_long", "SELECT doc_id, 'ok' AS parse_status, " + ", ".join(
    f"CAST(length(substr(coalesce(text, ''), 1, {n})) AS INTEGER) AS {k}_chars, md5(substr(coalesce(text, ''), 1, {n})) AS {k}_md5" for k, n in _long.items()) + " FROM documents")

oracle("telemetry_cost", """WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT max(value) FILTER (WHERE i = least(floor(0.5 * n), n - 1)) AS p50, max(value) FILTER (WHERE i = least(floor(0.95 * n), n - 1)) AS p95 FROM o),
a AS (SELECT count(value) AS llm_calls, count(*) FILTER (WHERE event_type = 'error') AS errors, sum(value) AS total FROM events)
SELECT llm_calls, errors, round_even(p50, 0) AS p50_ms, round_even(p95, 0) AS p95_ms, round_even(total / llm_calls, 0) AS avg_ms,
  (SELECT count(*) FROM documents) AS total_calls_in_db, 'replay' AS provider, 'none' AS model, CAST(llm_calls * 0.002::DOUBLE AS DOUBLE) AS estimated_cost_usd FROM a, p""")

_cls = ("CASE WHEN na_idx IS NULL THEN 'ignored' WHEN len(na_topics) > 0 AND na_digit THEN 'concrete' WHEN len(na_topics) > 0 THEN 'partial' "
        "WHEN na_generic THEN 'generic' ELSE 'ignored' END")
oracle("rules_reasons", _rules_sql(
    "SELECT call_id, 'objection replies: ' || coalesce((SELECT string_agg(" + _cls + ", ', ' ORDER BY idx) FROM tt WHERE tt.call_id = r3.call_id AND spk = 'Lead' "
    "AND objection), '') AS objection_reason, 'next-step asks: ' || CAST(n_asks AS VARCHAR) || '; site visit ' || site_visit_outcome AS next_step_reason, "
    "'site visit ' || site_visit_outcome || ' at stage ' || last_stage_reached AS action_reason"))

oracle("rules_gazetteer", _rules_sql("SELECT call_id, preferred_locations"))

from .oracles_ops import like  # noqa: E402
from .queries_store import SEARCHED  # noqa: E402
oracle("search_indexed", " UNION ALL ".join(
    f"SELECT {q(t)} AS term, source, CAST(count(*) AS BIGINT) AS hits FROM documents WHERE {like(t, ['text'])} GROUP BY source" for t in SEARCHED))
