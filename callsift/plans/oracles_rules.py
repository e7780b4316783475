"""DuckDB oracle of the rules analyzer: turns as rows, next turns by window frames,
per-call results by grouped aggregates (an independent formulation of R1-R9)."""

from __future__ import annotations

from .. import schema as S
from ..functions.text import TURN_RE
from ..operators import rules as R
from .oracle_base import with_ctes
from .oracles import oracle
from .oracles_ops import jsnum, q


def rx(p: str) -> str:
    return f"regexp_matches(u, {q(p)})"


_areas = "list_filter([" + ", ".join(f"CASE WHEN qm AND {rx(p)} THEN '{n}' END" for n, p in R.AREAS) + "], lambda a: a IS NOT NULL)"
_topics = "list_filter([" + ", ".join(f"CASE WHEN {rx(p)} THEN '{n}' END" for n, p in R.TOPICS) + "], lambda a: a IS NOT NULL)"
_bools = {"objection": R.OBJECTION_RE, "pushback": R.PUSHBACK_RE, "agree": R.AGREE_RE, "refuse": R.REFUSE_RE,
          "defer": R.DEFER_RE, "date": R.DATE_RE, "soft": R.SOFT_RE, "ask_visit": R.VISIT_ASK_RE, "ask_fu": R.FOLLOWUP_RE,
          "ask_br": R.BROCHURE_RE, "later": R.LATER_RE, "ended": R.ENDED_RE, "not_here": R.NOT_HERE_RE,
          "generic": R.GENERIC_RE, "greet": R.GREETING_RE, "escalate": R.ESCALATE_RE, "send": R.SEND_RE,
          "vague": R.VAGUE_RE, "digit": r"\d"}
_canon = "CASE p " + " ".join(f"WHEN {q(g.lower())} THEN {q(g)}" for g in R.GAZETTEER) + " END"
_stage_names = "[" + ", ".join(q(s) for s in S.LAST_STAGES) + "]"

RULES_CTES = [
    "ln AS MATERIALIZED (SELECT call_id, unnest(string_split(transcript, chr(10))) AS line, "
    "generate_subscripts(string_split(transcript, chr(10)), 1) - 1 AS idx FROM calls)",
    f"t0 AS MATERIALIZED (SELECT call_id, idx, regexp_extract(line, {q(TURN_RE)}, 6) AS spk, "
    f"lower(regexp_extract(line, {q(TURN_RE)}, 7)) AS u FROM ln)",
    "t1 AS MATERIALIZED (SELECT *, contains(u, '?') AS qm, regexp_extract_all(u, " + q(R.UNIT_RE) + ", 0)[-1] AS um, "
    f"regexp_extract(u, {q(R.AMOUNT_RE)}, 1) AS a1, regexp_extract(u, {q(R.AMOUNT_RE)}, 2) AS a2, "
    f"regexp_extract(u, {q(R.AMOUNT_RE)}, 3) AS a3, regexp_extract(u, {q(R.MONTHS_RE)}, 1) AS mo FROM t0 WHERE spk <> '')",
    "tf AS MATERIALIZED (SELECT call_id, idx, spk, u, qm, "
    "CASE WHEN um LIKE '%bhk%' THEN regexp_extract(um, '([234])', 1) || 'BHK' WHEN um LIKE 'villa%' THEN 'villa' "
    "WHEN um LIKE 'plot%' THEN 'plot' END AS unit, "
    "CASE WHEN a1 <> '' THEN CAST(a1 AS DOUBLE) * (CASE WHEN a3 LIKE 'c%' THEN 100.0 ELSE 1.0 END) END AS lo, "
    "CASE WHEN a1 <> '' THEN CAST(CASE WHEN a2 <> '' THEN a2 ELSE a1 END AS DOUBLE) * (CASE WHEN a3 LIKE 'c%' THEN 100.0 ELSE 1.0 END) END AS hi, "
    "CASE WHEN mo <> '' THEN CASE WHEN CAST(mo AS INTEGER) < 3 THEN 'immediate' WHEN CAST(mo AS INTEGER) < 6 THEN '3_to_6_months' "
    "WHEN CAST(mo AS INTEGER) <= 12 THEN '6_to_12_months' ELSE 'exploring' END END AS tl_months, "
    f"CASE WHEN {rx(R.IMMEDIATE_RE)} THEN 'immediate' WHEN {rx(R.EXPLORING_RE)} THEN 'exploring' END AS tl_kw, "
    f"regexp_extract_all(u, {q(R.PLACE_RE)}, 1) AS places, {_areas} AS areas, {_topics} AS topics, "
    + ", ".join(f"{rx(p)} AS {n}" for n, p in _bools.items()) + " FROM t1)",
    "tw AS MATERIALIZED (SELECT *, min(CASE WHEN spk = 'Lead' THEN idx END) OVER (PARTITION BY call_id ORDER BY idx "
    "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nl_idx, min(CASE WHEN spk = 'Agent' THEN idx END) OVER "
    "(PARTITION BY call_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS na_idx FROM tf)",
    "tt AS MATERIALIZED (SELECT t.*, nl.pushback AS nl_pushback, nl.agree AS nl_agree, nl.not_here AS nl_not_here, "
    "na.topics AS na_topics, na.digit AS na_digit, na.generic AS na_generic FROM tw t "
    "LEFT JOIN tw nl ON nl.call_id = t.call_id AND nl.idx = t.nl_idx LEFT JOIN tw na ON na.call_id = t.call_id AND na.idx = t.na_idx)",
    # per-turn stage rank
    # the turns that answer an objection, and those that answer a request
    "replies_to AS MATERIALIZED (SELECT call_id, idx, bool_or(objection) AS to_objection, bool_or(ask) AS to_ask FROM ("
    "SELECT call_id, na_idx AS idx, true AS objection, false AS ask FROM tt WHERE spk = 'Lead' AND objection AND na_idx IS NOT NULL UNION ALL "
    "SELECT call_id, nl_idx, false, true FROM tt WHERE spk = 'Agent' AND (ask_visit OR ask_fu OR ask_br) AND nl_idx IS NOT NULL) GROUP BY call_id, idx)",
    "tr AS MATERIALIZED (SELECT t.*, greatest(CASE WHEN greet THEN 1 ELSE 0 END, "
    "CASE WHEN spk = 'Agent' AND qm AND (len(areas) > 0 OR vague) THEN 2 ELSE 0 END, "
    "CASE WHEN spk = 'Agent' AND len(topics) > 0 THEN 3 ELSE 0 END, "
    "CASE WHEN spk = 'Agent' AND coalesce(x.to_objection, false) THEN 4 ELSE 0 END, "
    "CASE WHEN spk = 'Agent' AND (ask_visit OR ask_fu OR ask_br) THEN 5 ELSE 0 END, "
    "CASE WHEN spk = 'Lead' AND agree AND coalesce(x.to_ask, false) THEN 6 ELSE 0 END) AS rnk "
    "FROM tt t LEFT JOIN replies_to x ON x.call_id = t.call_id AND x.idx = t.idx)",
    "trw AS (SELECT *, coalesce(max(rnk) OVER (PARTITION BY call_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING), 0) AS prior_best FROM tr)",
    # per-call aggregates
    """agg AS MATERIALIZED (SELECT c.call_id,
  max_by(unit, idx) FILTER (WHERE spk = 'Lead' AND unit IS NOT NULL) AS lead_unit,
  max_by(unit, idx) FILTER (WHERE spk = 'Agent' AND unit IS NOT NULL) AS agent_unit,
  max_by(lo, idx) FILTER (WHERE spk = 'Lead' AND lo IS NOT NULL) AS l_lo, max_by(hi, idx) FILTER (WHERE spk = 'Lead' AND lo IS NOT NULL) AS l_hi,
  max_by(lo, idx) FILTER (WHERE spk = 'Agent' AND lo IS NOT NULL AND coalesce(NOT nl_pushback, false)) AS a_lo,
  max_by(hi, idx) FILTER (WHERE spk = 'Agent' AND lo IS NOT NULL AND coalesce(NOT nl_pushback, false)) AS a_hi,
  max_by(tl_months, idx) FILTER (WHERE spk = 'Lead' AND tl_months IS NOT NULL) AS tl_m,
  max_by(tl_kw, idx) FILTER (WHERE spk = 'Lead' AND tl_kw IS NOT NULL) AS tl_k,
  flatten(coalesce(list(places) FILTER (WHERE (spk = 'Lead' AND NOT not_here)
          OR (spk = 'Agent' AND qm AND coalesce(nl_agree AND NOT nl_not_here, false))), [])) AS all_places,
  max(idx) FILTER (WHERE spk = 'Agent' AND ask_visit) AS visit_idx,
  max(idx) FILTER (WHERE spk = 'Agent' AND (ask_visit OR ask_fu OR ask_br)) AS ask_idx,
  count(*) FILTER (WHERE spk = 'Agent' AND (ask_visit OR ask_fu OR ask_br)) AS n_asks,
  coalesce(bool_and(ask_br AND NOT ask_visit AND NOT ask_fu) FILTER (WHERE spk = 'Agent' AND (ask_visit OR ask_fu OR ask_br)), true) AS only_br,
  coalesce(bool_and(later AND NOT ask_visit AND NOT ask_br) FILTER (WHERE spk = 'Agent' AND (ask_visit OR ask_fu OR ask_br)), true) AS only_later,
  coalesce(bool_or(refuse) FILTER (WHERE spk = 'Lead'), false) AS any_refuse,
  coalesce(bool_or(escalate) FILTER (WHERE spk = 'Lead'), false) AS any_escalate,
  coalesce(bool_or(send) FILTER (WHERE spk = 'Lead'), false) AS any_send,
  coalesce(bool_or(defer) FILTER (WHERE spk = 'Lead'), false) AS any_defer,
  coalesce(bool_or(ended), false) AS any_ended,
  flatten(coalesce(list(areas) FILTER (WHERE spk = 'Agent' AND qm), [])) AS all_areas,
  count(*) FILTER (WHERE spk = 'Agent' AND qm AND len(areas) > 0) AS n_area_turns,
  coalesce(bool_or(len(areas) = 4) FILTER (WHERE spk = 'Agent' AND qm), false) AS has4,
  coalesce(bool_or(qm AND vague AND len(areas) = 0) FILTER (WHERE spk = 'Agent'), false) AS vague,
  list_sort(list_distinct(flatten(coalesce(list(topics) FILTER (WHERE spk = 'Agent'), [])))) AS topics,
  count(*) FILTER (WHERE spk = 'Lead' AND objection) AS n_obj,
  count(*) FILTER (WHERE spk = 'Lead' AND objection AND na_idx IS NOT NULL AND len(na_topics) > 0 AND na_digit) AS n_conc,
  count(*) FILTER (WHERE spk = 'Lead' AND objection AND na_idx IS NOT NULL AND len(na_topics) > 0 AND NOT na_digit) AS n_part,
  count(*) FILTER (WHERE spk = 'Lead' AND objection AND na_idx IS NOT NULL AND len(na_topics) = 0 AND na_generic) AS n_gen,
  max_by(rnk, idx) FILTER (WHERE rnk > 0 AND NOT (rnk = 1 AND prior_best >= 2)) AS stage_rank
FROM calls c LEFT JOIN trw t ON t.call_id = c.call_id GROUP BY c.call_id)""",
    """r1 AS MATERIALIZED (SELECT a.*, vr.idx AS vr_idx, vr.refuse AS vr_refuse, vr.agree AS vr_agree, vr.date AS vr_date, vr.defer AS vr_defer,
  ar.idx AS ar_idx, ar.agree AS ar_agree, ar.date AS ar_date, ar.defer AS ar_defer,
  coalesce(a.l_lo, a.a_lo) AS b_lo, CASE WHEN a.l_lo IS NOT NULL THEN a.l_hi ELSE a.a_hi END AS b_hi,
  len(list_distinct(a.all_areas)) AS n_areas
FROM agg a LEFT JOIN tw v ON v.call_id = a.call_id AND v.idx = a.visit_idx LEFT JOIN tw vr ON vr.call_id = a.call_id AND vr.idx = v.nl_idx
LEFT JOIN tw k ON k.call_id = a.call_id AND k.idx = a.ask_idx LEFT JOIN tw ar ON ar.call_id = a.call_id AND ar.idx = k.nl_idx)""",
    f"""r2 AS (SELECT *, coalesce(lead_unit, agent_unit, '{S.DEFAULT_UNIT}') AS unit_configuration,
  CASE WHEN b_lo IS NOT NULL AND (b_lo > 0 OR b_hi > 0) THEN least(b_lo, b_hi) END AS budget_min,
  CASE WHEN b_lo IS NOT NULL AND (b_lo > 0 OR b_hi > 0) THEN greatest(b_lo, b_hi) END AS budget_max,
  coalesce(tl_m, tl_k, '{S.DEFAULT_TIMELINE}') AS timeline,
  array_to_string(list_sort(list_distinct(list_transform(all_places, lambda p: {_canon}))), '|') AS preferred_locations,
  list_sort(list_distinct(list_transform(all_places, lambda p: {_canon}))) AS locs_list,
  CASE WHEN visit_idx IS NOT NULL THEN (CASE WHEN vr_idx IS NULL THEN 'call_cut' WHEN vr_refuse THEN 'declined'
       WHEN vr_agree AND vr_date THEN 'committed_with_date' WHEN vr_agree OR vr_defer THEN 'committed_no_date' ELSE 'not_asked' END)
    WHEN any_refuse THEN 'declined' WHEN any_ended THEN 'call_cut' ELSE 'not_asked' END AS site_visit_outcome,
  CASE WHEN n_areas = 4 THEN (CASE WHEN len(all_areas) > n_areas THEN 5 WHEN has4 AND n_area_turns = 1 THEN 3 ELSE 4 END)
    WHEN n_areas = 3 THEN 4 WHEN n_areas = 2 THEN 3 WHEN n_areas = 1 THEN 2 WHEN vague THEN 1 ELSE 0 END AS discovery_score,
  CAST(least(5, len(topics)) AS INTEGER) AS pitch_score,
  CASE WHEN n_obj = 0 THEN 3 WHEN n_conc = n_obj THEN 5 WHEN n_conc = n_obj - 1 AND n_conc > 0 THEN 4
    WHEN n_conc + n_part > 0 THEN 3 WHEN n_gen > 0 THEN 2 ELSE 1 END AS objection_handling_score,
  CASE WHEN n_asks = 0 THEN 0 WHEN ar_idx IS NOT NULL AND ar_agree AND ar_date THEN 5 WHEN ar_idx IS NOT NULL AND ar_agree THEN 4
    WHEN ar_idx IS NOT NULL AND ar_defer THEN 3 WHEN only_br THEN 2 WHEN only_later THEN 1 WHEN ar_idx IS NOT NULL THEN 3 ELSE 1 END AS next_step_score,
  CASE WHEN stage_rank IS NULL THEN '{S.DEFAULT_STAGE}' ELSE {_stage_names}[stage_rank] END AS last_stage_reached
FROM r1)""",
    f"""r3 AS (SELECT *, CASE WHEN any_refuse THEN 'mark_cold' WHEN any_escalate THEN 'escalate_to_manager'
    WHEN site_visit_outcome = 'committed_with_date' OR (visit_idx IS NOT NULL AND coalesce(vr_agree, false)) THEN 'confirm_site_visit'
    WHEN any_send THEN 'send_brochure_whatsapp' WHEN any_defer THEN 'schedule_callback_3_days'
    WHEN last_stage_reached = 'greeting' THEN 'mark_cold' ELSE 'no_action' END AS recommended_next_action FROM r2)""",
]


def _rules_sql(select: str) -> str:
    return with_ctes(["calls"], RULES_CTES) + select + " FROM r3"


oracle("rules_extraction", _rules_sql("SELECT call_id, unit_configuration, budget_min, budget_max, timeline, "
                                      "preferred_locations, site_visit_outcome"))
oracle("rules_scores", _rules_sql("SELECT call_id, CAST(discovery_score AS INTEGER) AS discovery_score, pitch_score, "
                                  "CAST(objection_handling_score AS INTEGER) AS objection_handling_score, "
                                  "CAST(next_step_score AS INTEGER) AS next_step_score"))
oracle("rules_stage_action", _rules_sql("SELECT call_id, last_stage_reached, recommended_next_action"))
_area_names = "[" + ", ".join(q(n) for n, _ in R.AREAS) + "]"
_topic_names = "[" + ", ".join(q(n) for n, _ in R.TOPICS) + "]"
_bud = (f"CASE WHEN budget_min IS NULL THEN 'Not discussed' WHEN budget_min = budget_max THEN {jsnum('budget_min')} || ' L' "
        f"ELSE {jsnum('budget_min')} || '–' || {jsnum('budget_max')} || ' L' END")
oracle("rules_text", _rules_sql(
    "SELECT call_id, 'asked about ' || array_to_string(list_sort(list_distinct(all_areas)), ', ') || '; skipped ' || "
    f"array_to_string(list_filter({_area_names}, lambda x: NOT list_contains(all_areas, x)), ', ') AS discovery_reason, "
    "'covered ' || array_to_string(topics, ', ') || '; missing ' || "
    f"array_to_string(list_filter({_topic_names}, lambda x: NOT list_contains(topics, x)), ', ') AS pitch_reason, "
    f"'Lead discussed ' || unit_configuration || ', ' || {_bud} || '. Outcome: ' || site_visit_outcome || "
    "', stage ' || last_stage_reached || '.' AS summary"))

# ----------------------------------------------------------------- wished-for items
from ..operators import extras as X  # noqa: E402
from .oracle_validate import validated_cte  # noqa: E402
from .oracles_ops import STORED, with_stored  # noqa: E402

oracle("list_date_range", with_stored() + "SELECT call_id, overall_score FROM stored WHERE ts >= TIMESTAMP '2024-01-01 02:00:00' "
       "AND ts < TIMESTAMP '2024-01-01 05:00:00' AND overall_score >= 1.0 AND overall_score <= 3.0")

_adj = " OR ".join(f"(p_sv = '{a}' AND g_sv = '{b}') OR (p_sv = '{b}' AND g_sv = '{a}')" for a, b in X.ADJACENT_VISITS)
from .oracles_ops import _PAIRS  # noqa: E402
oracle("eval_visit_partial", with_ctes(["replies"], validated_cte("replies") + [_PAIRS]) + f"""SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE p_sv = g_sv) AS BIGINT) AS exact, CAST(count(*) FILTER (WHERE {_adj}) AS BIGINT) AS adjacent,
  (count(*) FILTER (WHERE p_sv = g_sv) * 2 + count(*) FILTER (WHERE {_adj})) / (count(*) * 2.0)::DOUBLE AS credit
FROM pairs WHERE parse_status = 'ok'""")

oracle("normalized_hash", f"SELECT doc_id, substr(sha256(regexp_replace(lower(text), {q(X.NORMALIZE_RE)}, '', 'g')), 1, 32) "
       "AS norm_hash FROM documents")

oracle("intro_name", with_ctes(["calls"]) + f"""SELECT call_id, nullif(regexp_extract(regexp_extract(transcript,
  {q(X.FIRST_AGENT_RE)}, 1), {q(X.INTRO_RE)}, 1), '') AS intro_name FROM calls""")

_VER = {
    "unit_configuration": "coalesce(s.unit_configuration = r.unit_configuration, false)",
    "budget_range": "(s.budget_min IS NOT DISTINCT FROM r.budget_min AND s.budget_max IS NOT DISTINCT FROM r.budget_max)",
    "timeline": "coalesce(s.timeline = r.timeline, false)",
    "preferred_locations": "coalesce(list_sort(list_transform(s.preferred_locations, lambda x: lower(x))) = "
                           "list_sort(list_transform(r.locs_list, lambda x: lower(x))), false)",
    "site_visit_outcome": "coalesce(s.site_visit_outcome = r.site_visit_outcome, false)",
    "last_stage_reached": "coalesce(s.last_stage_reached = r.last_stage_reached, false)",
    "recommended_next_action": "coalesce(s.recommended_next_action = r.recommended_next_action, false)",
}
oracle("verifier_disagreements", with_ctes(["calls", "replies"], validated_cte("replies") + [STORED] + RULES_CTES) +
       " UNION ALL ".join(f"SELECT '{f}' AS field, CAST(count(*) FILTER (WHERE NOT {m}) AS BIGINT) AS disagreements, "
                          f"CAST(count(*) AS BIGINT) AS total FROM stored s JOIN r3 r ON r.call_id = s.call_id"
                          for f, m in _VER.items()))

oracle("bulk_reassign", with_stored() + """SELECT call_id,
  CASE WHEN lead_id IN (SELECT 'LEAD_' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
       THEN 'TC_900' ELSE telecaller_id END AS telecaller_id,
  CASE WHEN lead_id IN (SELECT 'LEAD_' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
       THEN 'Reassigned' ELSE telecaller_name END AS telecaller_name FROM stored""")

oracle("response_record", with_stored() + "SELECT call_id, false AS cached, unit_configuration, pitch_score, "
       "last_stage_reached, recommended_next_action, next_action_reason, summary FROM stored")

oracle("batch_run", with_ctes(["calls", "replies"], validated_cte("replies")) + """SELECT status, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN c.conv_id % 2 = 0 AND v.parse_status = 'ok' THEN 'skipped' WHEN v.parse_status = 'ok' THEN 'ok'
              ELSE 'fail' END AS status
  FROM calls c JOIN validated v ON v.conv_id = c.conv_id) GROUP BY status""")

from .oracles_ops import _EDITS  # noqa: E402
_r8 = ("CASE WHEN r.any_refuse THEN 'mark_cold' WHEN r.any_escalate THEN 'escalate_to_manager' "
       "WHEN coalesce(e.\"extraction.site_visit_outcome\", s.site_visit_outcome) = 'committed_with_date' "
       "OR (r.visit_idx IS NOT NULL AND coalesce(r.vr_agree, false)) THEN 'confirm_site_visit' "
       "WHEN r.any_send THEN 'send_brochure_whatsapp' WHEN r.any_defer THEN 'schedule_callback_3_days' "
       "WHEN coalesce(e.\"last_stage_reached\", s.last_stage_reached) = 'greeting' THEN 'mark_cold' ELSE 'no_action' END")
oracle("edit_next_action", with_ctes(["calls", "replies"], validated_cte("replies") + [STORED] + _EDITS + RULES_CTES) +
       f"""SELECT s.call_id, CASE WHEN e.call_id IS NULL THEN s.recommended_next_action
  WHEN e."recommended_next_action" IS NOT NULL THEN e."recommended_next_action" ELSE {_r8} END AS recommended_next_action
FROM stored s LEFT JOIN pv e ON e.call_id = s.call_id JOIN r1 r ON r.call_id = s.call_id""")
