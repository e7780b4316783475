"""DuckDB oracles for the view / metric / rubric / dedup / ingest / store queries."""

from __future__ import annotations

from .. import schema as S
from ..operators import rubric as R
from ..operators import store as ST
from .oracle_base import hash_sql, pad_sql, strip_sql, with_ctes
from .oracle_validate import validated_cte
from .oracles import oracle

INGEST_TS = "2026-01-02 03:04:05"
N_CONV = "(SELECT max(conv_id) + 1 FROM conversations)"
SUMQ = "(v.discovery_score + v.pitch_score + v.objection_handling_score + v.next_step_score)"
STORED = ("stored AS (SELECT c.*, " + hash_sql("c.transcript") + " AS transcript_hash, v.* EXCLUDE (conv_id), "
          f"{SUMQ} AS score_quarters, CAST({SUMQ} AS DOUBLE) / 4 AS overall_score "
          "FROM calls c JOIN validated v ON v.conv_id = c.conv_id WHERE v.parse_status = 'ok')")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_stored(*extra: str) -> str:
    return with_ctes(["calls", "replies"], validated_cte("replies") + [STORED, *extra])


def ts_text(c: str = "ts") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# ----------------------------------------------------------------- views
oracle("list_view", with_stored() + f"""SELECT call_id, telecaller_id, telecaller_name, lead_id, lead_name, duration_sec,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, overall_score, site_visit_outcome, last_stage_reached,
  recommended_next_action, unit_configuration, timeline, discovery_score, pitch_score, objection_handling_score,
  next_step_score FROM stored""")


def like(term: str, cols: list[str]) -> str:
    pat = "%" + term.strip().lower().replace("~", "~~") + "%"
    return "(" + " OR ".join(f"lower({c}) LIKE {q(pat)} ESCAPE '~'" for c in cols) + ")"


oracle("list_filtered", with_stored() + "SELECT call_id, telecaller_name, overall_score, discovery_score, site_visit_outcome "
       "FROM stored WHERE " + like("budget", ["transcript", "telecaller_name", "lead_name"]) +
       " AND site_visit_outcome = 'declined' AND coalesce(overall_score, 0) >= 1.0 AND coalesce(discovery_score, 0) >= 1")

oracle("list_sorted", with_stored() + "SELECT call_id, overall_score FROM stored "
       "")

oracle("filter_counts", with_stored() + "SELECT CAST(count(*) FILTER (WHERE coalesce(overall_score, 0) >= 1.5 "
       "AND coalesce(discovery_score, 0) >= 0) AS BIGINT) AS shown, CAST(count(*) AS BIGINT) AS total FROM stored")

oracle("telecaller_names", with_stored() + "SELECT DISTINCT telecaller_name FROM stored")

oracle("search_calls", with_stored() + "SELECT call_id, lead_name FROM stored WHERE " +
       like("Site Visit", ["transcript", "telecaller_name", "lead_name"]))

oracle("search_documents", "SELECT source, CAST(count(*) AS BIGINT) AS hits FROM documents WHERE " +
       like("les_", ["text"]) + " GROUP BY source")


def jsnum(x: str) -> str:
    return (f"CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({x} AS VARCHAR) END")


_local = "(ts + INTERVAL 330 MINUTE)"
oracle("detail_labels", with_stored() + f"""SELECT call_id, lead_name || ' · ' || telecaller_name AS title,
  strftime({_local}, '%-d %b, %I:%M ') || lower(strftime({_local}, '%p')) AS date_text,
  CAST(duration_sec // 60 AS VARCHAR) || ':' || lpad(CAST(duration_sec % 60 AS VARCHAR), 2, '0') AS duration_text,
  CASE WHEN budget_min IS NULL THEN 'Not discussed' WHEN budget_min = budget_max THEN {jsnum('budget_min')} || ' L'
       ELSE {jsnum('budget_min')} || '–' || {jsnum('budget_max')} || ' L' END AS budget_label,
  CASE WHEN len(preferred_locations) > 0 THEN array_to_string(preferred_locations, ', ') ELSE 'None' END AS locations_label,
  CAST((score_quarters * 25) // 100 AS VARCHAR) || '.' || lpad(CAST((score_quarters * 25) % 100 AS VARCHAR), 2, '0') AS overall_text,
  CAST(((score_quarters * 20 + 4) // 8) // 10 AS VARCHAR) || '.' || CAST(((score_quarters * 20 + 4) // 8) % 10 AS VARCHAR) AS list_score_text,
  CAST(least(5, greatest(0, floor(overall_score + 0.5))) AS INTEGER) AS score_band
FROM stored""")

oracle("call_lookup", with_stored() + "SELECT call_id, lead_name, overall_score FROM stored WHERE call_id IN "
       "(SELECT 'CALL_' || " + pad_sql('event_id % ' + N_CONV, 6) + " FROM events WHERE event_type = 'error')")

oracle("call_count", with_stored() + "SELECT CAST(count(*) AS BIGINT) AS n FROM stored")

# ----------------------------------------------------------------- metrics
_PCT = """pv AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS rn, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
qs AS (SELECT unnest([{qs}]) AS q)"""


def _pct_sql(qs: list[float]) -> str:
    return _PCT.format(qs=", ".join(f"{x}::DOUBLE" for x in qs))


oracle("latency_percentiles", "WITH " + _pct_sql([0.5, 0.9, 0.95, 0.99]) +
       "\nSELECT qs.q, pv.value FROM qs JOIN pv ON pv.rn = least(floor(qs.q * pv.n), pv.n - 1)")

oracle("latency_telemetry", with_stored(_pct_sql([0.5, 0.95]),
       "p AS (SELECT max(CASE WHEN qs.q = 0.5 THEN pv.value END) AS p50, max(CASE WHEN qs.q = 0.95 THEN pv.value END) AS p95 "
       "FROM qs JOIN pv ON pv.rn = least(floor(qs.q * pv.n), pv.n - 1))",
       "a AS (SELECT count(value) AS llm_calls, count(*) FILTER (WHERE event_type = 'error') AS errors, sum(value) AS total FROM events)")
       + """SELECT a.llm_calls, a.errors, round_even(coalesce(p.p50, 0.0), 0) AS p50_ms, round_even(coalesce(p.p95, 0.0), 0) AS p95_ms,
  CASE WHEN a.llm_calls > 0 THEN round_even(a.total / a.llm_calls, 0) ELSE 0.0 END AS avg_ms,
  (SELECT count(*) FROM stored) AS total_calls_in_db, 'replay' AS provider, 'none' AS model,
  CAST(a.llm_calls * 0.0 AS DOUBLE) AS estimated_cost_usd FROM a, p""")

_PAIRS = """pairs AS (
  SELECT g.conv_id, p.parse_status,
    g.unit_configuration AS g_unit, p.unit_configuration AS p_unit, g.timeline AS g_tl, p.timeline AS p_tl,
    g.site_visit_outcome AS g_sv, p.site_visit_outcome AS p_sv, g.last_stage_reached AS g_st, p.last_stage_reached AS p_st,
    g.recommended_next_action AS g_ac, p.recommended_next_action AS p_ac,
    g.budget_min AS g_bmin, g.budget_max AS g_bmax, p.budget_min AS p_bmin, p.budget_max AS p_bmax,
    g.preferred_locations AS g_locs, p.preferred_locations AS p_locs,
    """ + ", ".join(f"CASE WHEN g.conv_id % 10 = 0 THEN NULL ELSE g.{d}_score END AS g_{d}, p.{d}_score AS p_{d}"
                    for d in S.DIMENSIONS) + """
  FROM validated g JOIN validated p ON p.conv_id = g.conv_id + 1 WHERE g.parse_status = 'ok')"""

_MATCH = {
    "unit_configuration": "coalesce(p_unit = g_unit, false)",
    "budget_range": "(p_bmin IS NOT DISTINCT FROM g_bmin AND p_bmax IS NOT DISTINCT FROM g_bmax)",
    "timeline": "coalesce(p_tl = g_tl, false)",
    "preferred_locations": "coalesce(list_sort(list_transform(p_locs, lambda x: lower(x))) = "
                           "list_sort(list_transform(g_locs, lambda x: lower(x))), false)",
    "site_visit_outcome": "coalesce(p_sv = g_sv, false)",
    "last_stage_reached": "coalesce(p_st = g_st, false)",
    "recommended_next_action": "coalesce(p_ac = g_ac, false)",
}
oracle("eval_fields", with_ctes(["replies"], validated_cte("replies") + [_PAIRS]) + " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(count(*) FILTER (WHERE {m}) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total, "
    f"CASE WHEN count(*) > 0 THEN round_even(CAST(count(*) FILTER (WHERE {m}) AS DOUBLE) * 100 / count(*), 1) END AS pct "
    f"FROM pairs WHERE parse_status = 'ok'" for f, m in _MATCH.items()))

oracle("eval_dimensions", with_ctes(["replies"], validated_cte("replies") + [_PAIRS]) + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST(count(*) FILTER (WHERE g_{d} IS NOT NULL AND p_{d} = g_{d}) AS BIGINT) AS exact, "
    f"CAST(count(*) FILTER (WHERE g_{d} IS NOT NULL AND abs(p_{d} - g_{d}) <= 1) AS BIGINT) AS adjacent, "
    f"CAST(count(*) AS BIGINT) AS total FROM pairs WHERE parse_status = 'ok'" for d in S.DIMENSIONS))

oracle("eval_failures", with_ctes(["replies"], validated_cte("replies") + [_PAIRS]) +
       "SELECT parse_status, CAST(count(*) AS BIGINT) AS n FROM pairs GROUP BY parse_status")

_LABELS = [
    "preds AS (SELECT c.call_id, c.conv_id, " + hash_sql("c.transcript") + " AS th, v.* EXCLUDE (conv_id) FROM calls c "
    "JOIN validated v ON v.conv_id = c.conv_id)",
    "same AS (SELECT * FROM preds QUALIFY row_number() OVER (PARTITION BY th ORDER BY call_id) = 1)",
    # a label without a call_id is paired with the first call of its transcript
    "lp AS (SELECT l.call_id AS own_id, l.conv_id AS g, p.* FROM preds l JOIN preds p ON p.call_id = l.call_id WHERE l.conv_id % 4 <> 0 "
    "UNION ALL SELECT NULL, l.conv_id, p.* FROM preds l JOIN same p ON p.th = l.th WHERE l.conv_id % 4 = 0)",
]
_LABEL_MATCH = {
    "unit_configuration": "unit_configuration = '2BHK'", "timeline": "timeline = 'immediate'",
    "budget_range": "CASE g % 3 WHEN 0 THEN false WHEN 1 THEN budget_min IS NULL "
                    "ELSE coalesce(budget_min = 0 AND budget_max = 60, false) END",
    "preferred_locations": "len(preferred_locations) = 0", "site_visit_outcome": "false",
    "last_stage_reached": "last_stage_reached = 'pitch'", "recommended_next_action": "recommended_next_action = 'mark_cold'",
}
oracle("label_accuracy", with_ctes(["calls", "replies"], validated_cte("replies") + _LABELS) + " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST(count(*) FILTER (WHERE {m}) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total, "
    f"CASE WHEN count(*) > 0 THEN round_even(CAST(count(*) FILTER (WHERE {m}) AS DOUBLE) * 100 / count(*), 1) END AS pct "
    f"FROM lp WHERE parse_status = 'ok'" for f, m in _LABEL_MATCH.items()))
oracle("label_failures", with_ctes(["calls", "replies"], validated_cte("replies") + _LABELS) +
       "SELECT own_id AS call_id, th AS transcript_hash, parse_status FROM lp WHERE parse_status <> 'ok'")

oracle("eval_labels", """WITH j AS (SELECT l.quality, l.toxic, d.n_chars, d.text FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
a AS (SELECT count(*) AS total, count(*) FILTER (WHERE CAST(n_chars >= 300 AS INTEGER) = quality) AS cq,
  count(*) FILTER (WHERE CAST(contains(lower(text), 'hate') AS INTEGER) = toxic) AS ct FROM j)
SELECT 'quality' AS field, CAST(cq AS BIGINT) AS correct, CAST(total AS BIGINT) AS total, round_even(CAST(cq AS DOUBLE) * 100 / total, 1) AS pct FROM a
UNION ALL SELECT 'toxic', CAST(ct AS BIGINT), CAST(total AS BIGINT), round_even(CAST(ct AS DOUBLE) * 100 / total, 1) FROM a""")

# ----------------------------------------------------------------- rubric / prompt
oracle("prompt_messages", with_ctes(["calls"]) + f"""SELECT call_id, 2 AS n_messages, 'system' AS first_role,
  CAST(length({q(R.SYSTEM_PROMPT)}) AS INTEGER) AS system_chars, sha256({q(R.SYSTEM_PROMPT)}) AS system_sha,
  sha256(transcript) AS user_sha FROM calls""")

_rub = ", ".join(f"({q(d)}, {s}, {q(a)})" for d, _o, s, a, _desc, _n in R.rubric_rows())
oracle("score_anchor", with_stored(f"rub(dimension, score, anchor) AS (VALUES {_rub})",
       "lng AS (" + " UNION ALL ".join(f"SELECT call_id, '{d}' AS dimension, {d}_score AS score FROM stored"
                                       for d in S.DIMENSIONS) + ")") +
       "SELECT l.call_id, l.dimension, CAST(l.score AS INTEGER) AS score, r.anchor, replace(l.dimension, '_', ' ') AS dimension_label "
       "FROM lng l LEFT JOIN rub r ON r.dimension = l.dimension AND r.score = l.score")

# ----------------------------------------------------------------- dedup
oracle("skip_seen", with_ctes(["calls"]) + "SELECT call_id FROM calls WHERE call_id NOT IN "
       "(SELECT call_id FROM calls WHERE conv_id % 2 = 0)")

_DOCS = f"dc AS (SELECT doc_id, 'DOC_' || CAST(doc_id AS VARCHAR) AS call_id, {hash_sql('text')} AS transcript_hash FROM documents)"
oracle("cache_hits", "WITH " + _DOCS + """,
reps AS (SELECT transcript_hash, min(call_id) AS cached_call_id FROM dc WHERE doc_id % 2 = 0 GROUP BY transcript_hash)
SELECT b.doc_id, r.cached_call_id IS NOT NULL AS cached, r.cached_call_id FROM dc b LEFT JOIN reps r
  ON r.transcript_hash = b.transcript_hash WHERE b.doc_id % 2 = 1""")

oracle("dedup_by_hash", "WITH " + _DOCS + """,
reps AS (SELECT transcript_hash, min(doc_id) AS first_doc_id FROM dc GROUP BY transcript_hash)
SELECT d.doc_id, r.first_doc_id, d.doc_id = r.first_doc_id AS is_first FROM dc d JOIN reps r ON r.transcript_hash = d.transcript_hash""")

# ----------------------------------------------------------------- ingest
_keys = S.PAYLOAD_KEYS
_PAY = ("pay AS (SELECT doc_id, " + ", ".join(
    f"CASE WHEN doc_id % 4 = {i} THEN (CASE WHEN doc_id % 13 = 0 THEN '  ' || chr(10) || ' ' ELSE text END) END AS {k}"
    for i, k in enumerate(_keys)) +
    ", CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE source END AS telecaller_name, "
    "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lead_name FROM documents)")
_pick = "coalesce(" + ", ".join(f"nullif({strip_sql(k)}, '')" for k in _keys) + ")"
_PICKED = f"pk AS (SELECT *, {_pick} AS _t FROM pay)"
oracle("payload_pick", "WITH " + _PAY + ",\n" + _PICKED + f"""
SELECT doc_id, _t IS NOT NULL AS accepted, {hash_sql('_t')} AS transcript_hash, CAST(length(_t) AS INTEGER) AS picked_chars FROM pk""")

_STAMP = r"\[(\d+):(\d+)-(\d+):(\d+)\]"
oracle("upload_defaults", "WITH " + _PAY + ",\n" + _PICKED + f"""
SELECT doc_id, 'UPLOAD_20260102T030405_' || {hash_sql('_t')} AS call_id, 'UPLOAD' AS telecaller_id,
  coalesce(nullif(telecaller_name, ''), 'Uploaded') AS telecaller_name, 'UPLOAD' AS lead_id,
  coalesce(nullif(lead_name, ''), 'Uploaded Lead') AS lead_name,
  coalesce(CAST(regexp_extract_all(_t, '{_STAMP}', 3)[-1] AS BIGINT) * 60 + CAST(regexp_extract_all(_t, '{_STAMP}', 4)[-1] AS BIGINT), 0) AS duration_sec
FROM pk WHERE _t IS NOT NULL""")

oracle("required_fields", with_ctes(["calls"]) + """SELECT call_id,
  NOT (conv_id % 15 = 7 OR conv_id % 10 = 3 OR call_id IS NULL OR telecaller_name IS NULL OR lead_id IS NULL
       OR duration_sec IS NULL OR ts IS NULL OR transcript IS NULL) AS valid FROM calls""")

oracle("ingest_summary", with_ctes(["calls", "replies"], validated_cte("replies")) + """SELECT status, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN c.conv_id % 2 = 0 THEN 'skipped' WHEN v.parse_status = 'ok' THEN 'ok' ELSE 'fail' END AS status
  FROM calls c LEFT JOIN validated v ON v.conv_id = c.conv_id) GROUP BY status""")

oracle("first_n", with_ctes(["calls"]) + f"SELECT call_id, {ts_text()} AS timestamp FROM calls ORDER BY ts, call_id LIMIT 25")

# ----------------------------------------------------------------- store
_OLD_NEW = [
    "okv AS (SELECT v.*, " + SUMQ + " AS score_quarters FROM validated v WHERE v.parse_status = 'ok')",
    "old AS (SELECT c.call_id, c.lead_name, " + hash_sql("c.transcript") + " AS transcript_hash, "
    "CAST(v.score_quarters AS DOUBLE) / 4 AS overall_score, c.ts AS created_at, c.ts FROM calls c JOIN okv v ON v.conv_id = c.conv_id "
    "WHERE c.conv_id % 2 = 0)",
    "new AS (SELECT c.call_id, upper(c.lead_name) AS lead_name, " + hash_sql("c.transcript || chr(10) || '[resent]'") +
    " AS transcript_hash, CAST(v.score_quarters AS DOUBLE) / 4 AS overall_score, c.ts FROM calls c JOIN okv v ON v.conv_id = c.conv_id + 1)",
]
oracle("upsert_calls", with_ctes(["calls", "replies"], validated_cte("replies") + _OLD_NEW) + f"""SELECT
  coalesce(o.call_id, n.call_id) AS call_id, CASE WHEN o.call_id IS NOT NULL THEN o.lead_name ELSE n.lead_name END AS lead_name,
  CASE WHEN n.call_id IS NOT NULL THEN n.transcript_hash ELSE o.transcript_hash END AS transcript_hash,
  CASE WHEN n.call_id IS NOT NULL THEN n.overall_score ELSE o.overall_score END AS overall_score,
  {ts_text("coalesce(o.created_at, TIMESTAMP '" + INGEST_TS + "')")} AS created_at,
  CAST(CAST(CASE WHEN o.call_id IS NOT NULL THEN o.ts ELSE n.ts END AS DATE) AS VARCHAR) AS call_date
FROM old o FULL OUTER JOIN new n ON o.call_id = n.call_id""")

_fields = list(ST.EDITABLE)
_nf = len(_fields)
_field_case = "CASE WHEN event_id % 10 = 9 THEN 'extraction.bogus' " + " ".join(
    f"WHEN event_id % {_nf} = {i} THEN '{f}'" for i, f in enumerate(_fields)) + " END"
_val_parts = []
for _f, _allowed in ST.EDITABLE.items():
    if _allowed == "score":
        _val_parts.append(f"WHEN fld = '{_f}' THEN ' ' || CAST((event_id // {_nf}) % 7 AS VARCHAR)")
    else:
        _opts = list(_allowed) + ["bogus"]
        _val_parts.append(f"WHEN fld = '{_f}' THEN [{', '.join(q(o) for o in _opts)}][(event_id // {_nf}) % {len(_opts)} + 1]")
_EDITS = [
    f"e0 AS (SELECT event_id, ts, {_field_case} AS fld FROM events)",
    "edits AS (SELECT 'CALL_' || " + pad_sql('event_id % ' + N_CONV, 6) + " AS call_id, fld AS field, event_id, "
    f"coalesce(CASE {' '.join(_val_parts)} END, 'x') AS value, ts AS edited_at FROM e0)",
]
_NUM = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_valid = " OR ".join(
    (f"(field = '{f}' AND regexp_matches({strip_sql('value')}, '{_NUM}'))" if a == "score" else
     f"(field = '{f}' AND {strip_sql('value')} IN ({', '.join(q(o) for o in a)}))") for f, a in ST.EDITABLE.items())
_EDITS += [
    f"lk AS (SELECT l.*, ({_valid}) AS ok, l.call_id IN (SELECT call_id FROM stored) AS known FROM edits l)",
    "last AS (SELECT * FROM lk WHERE ok AND known QUALIFY row_number() OVER "
    "(PARTITION BY call_id, field ORDER BY edited_at DESC, event_id DESC) = 1)",
    "pv AS (SELECT call_id, " + ", ".join(f"max(CASE WHEN field = '{f}' THEN {strip_sql('value')} END) AS \"{f}\"" for f in _fields) +
    " FROM last GROUP BY call_id)",
]


def _score_text(x: str) -> str:
    s = strip_sql(x)
    return (f"CASE WHEN regexp_matches({s}, '{_NUM}') AND NOT isinf(TRY_CAST({s} AS DOUBLE)) THEN "
            f"CAST(least(5.0, greatest(0.0, round_even(TRY_CAST({s} AS DOUBLE), 0))) AS INTEGER) ELSE 0 END")


_sc = {d: f"CASE WHEN e.\"quality_scores.{d}.score\" IS NOT NULL THEN {_score_text(chr(101) + '.' + chr(34) + f'quality_scores.{d}.score' + chr(34))} ELSE s.{d}_score END"
       for d in S.DIMENSIONS}
oracle("apply_edits", with_stored(*_EDITS) + f"""SELECT s.call_id,
  coalesce(e."extraction.site_visit_outcome", s.site_visit_outcome) AS site_visit_outcome,
  coalesce(e."extraction.timeline", s.timeline) AS timeline,
  coalesce(e."last_stage_reached", s.last_stage_reached) AS last_stage_reached,
  coalesce(e."recommended_next_action", s.recommended_next_action) AS recommended_next_action,
  {', '.join(f'{_sc[d]} AS {d}_score' for d in S.DIMENSIONS)},
  CAST({' + '.join(_sc[d] for d in S.DIMENSIONS)} AS DOUBLE) / 4 AS overall_score,
  e.call_id IS NOT NULL AS edited
FROM stored s LEFT JOIN pv e ON e.call_id = s.call_id""")

oracle("edit_quarantine", with_stored(*_EDITS) + """SELECT call_id, field, CASE WHEN NOT known THEN 'call not found'
  ELSE 'invalid field or value' END AS reason FROM lk WHERE NOT known OR NOT ok""")

# ----------------------------------------------------------------- inference (replayed replies)
_INF = ("SELECT c.call_id, v.parse_status, CAST({att} AS INTEGER) AS attempts, "
        "CASE WHEN v.parse_status = 'ok' THEN CAST(" + SUMQ + " AS DOUBLE) / 4 END AS overall_score "
        "FROM calls c JOIN validated v ON v.conv_id = c.conv_id")
oracle("infer_replay", with_ctes(["calls", "replies"], validated_cte("replies")) +
       _INF.format(att="CASE WHEN v.parse_status = 'ok' THEN 1 ELSE 3 END"))
_first = "substr(" + hash_sql("c.transcript") + ", 1, 1) IN ('0','1','2','3','4','5','6','7')"
oracle("infer_retry", with_ctes(["calls", "replies"], validated_cte("replies")) +
       _INF.format(att=f"CASE WHEN v.parse_status <> 'ok' THEN 3 WHEN {_first} THEN 2 ELSE 1 END"))

oracle("stream_upload", with_ctes(["calls", "replies"], validated_cte("replies")) + """SELECT d.doc_key,
  CASE WHEN v.parse_status = 'ok' THEN 'UPLOAD_20260102T030405_' || """ + hash_sql("c.transcript") + """ ELSE NULL END AS call_id, d.again AND v.parse_status = 'ok' AS cached,
  CASE WHEN v.parse_status = 'ok' THEN CAST(""" + SUMQ + """ AS DOUBLE) / 4 END AS overall_score, v.parse_status AS status
FROM calls c JOIN validated v ON v.conv_id = c.conv_id
JOIN (SELECT conv_id, call_id AS doc_key, false AS again FROM calls
      UNION ALL SELECT conv_id, call_id || '#2', true FROM calls WHERE conv_id % 5 = 0) d ON d.conv_id = c.conv_id""")

# ----------------------------------------------------------------- S6 JSON export
_qs_json = ", ".join(f"'{d}', json_object('score', {d}_score, 'reason', {d}_reason)" for d in S.DIMENSIONS)
oracle("analysis_json", with_ctes(["replies"], validated_cte("replies")) + f"""SELECT conv_id, CAST(json_object(
  'extraction', json_object('unit_configuration', unit_configuration,
     'budget_range', CASE WHEN budget_min IS NULL THEN to_json('not_discussed')
                          ELSE json_object('min_lakhs', budget_min, 'max_lakhs', budget_max) END,
     'timeline', timeline, 'preferred_locations', to_json(preferred_locations), 'site_visit_outcome', site_visit_outcome),
  'quality_scores', json_object({_qs_json}),
  'last_stage_reached', last_stage_reached, 'recommended_next_action', recommended_next_action,
  'next_action_reason', next_action_reason, 'summary', summary) AS VARCHAR) AS analysis_json
FROM validated WHERE parse_status = 'ok'""")
