"""DuckDB SQL re-statement of reply validation (V1-V10), for the oracles.

Written independently of the Spark expressions: it follows the reference's
Python validation on DuckDB's JSON functions.  ``validated_cte(src)`` yields
CTEs ending in ``validated`` with one row per input row of ``src`` (which
must have columns ``conv_id`` and ``reply``).
"""

from __future__ import annotations

from .. import schema as S
from .oracle_base import PY_SPACE_RE2, strip_sql

FENCE = rf"(?s)```(?:json)?{PY_SPACE_RE2}*(\{{.*\}}){PY_SPACE_RE2}*```"
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"
NUM_TYPES = "('BIGINT','UBIGINT','DOUBLE')"


def jt(j: str) -> str:
    return f"json_type({j})"


def jstr(j: str) -> str:
    return f"json_extract_string({j}, '$')"


def truthy(j: str) -> str:
    return (f"coalesce(CASE {jt(j)} WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN {jstr(j)} = 'true' "
            f"WHEN 'BIGINT' THEN CAST({jstr(j)} AS DOUBLE) <> 0 WHEN 'UBIGINT' THEN CAST({jstr(j)} AS DOUBLE) <> 0 "
            f"WHEN 'DOUBLE' THEN CAST({jstr(j)} AS DOUBLE) <> 0 "
            f"WHEN 'VARCHAR' THEN length({jstr(j)}) > 0 WHEN 'ARRAY' THEN json_array_length({j}) > 0 "
            f"WHEN 'OBJECT' THEN len(json_keys({j})) > 0 END, false)")


def pystr(j: str) -> str:
    return (f"CASE {jt(j)} WHEN 'NULL' THEN 'None' WHEN 'VARCHAR' THEN {jstr(j)} "
            f"WHEN 'BOOLEAN' THEN CASE WHEN {jstr(j)} = 'true' THEN 'True' ELSE 'False' END "
            f"WHEN 'BIGINT' THEN {jstr(j)} WHEN 'UBIGINT' THEN {jstr(j)} "
            f"WHEN 'DOUBLE' THEN CAST(CAST({jstr(j)} AS DOUBLE) AS VARCHAR) ELSE CAST({j} AS VARCHAR) END")


def to_float(j: str) -> str:
    s = strip_sql(jstr(j))
    return (f"CASE WHEN {jt(j)} = 'BOOLEAN' THEN CASE WHEN {jstr(j)} = 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END "
            f"WHEN {jt(j)} IN {NUM_TYPES} THEN CAST({jstr(j)} AS DOUBLE) "
            f"WHEN {jt(j)} = 'VARCHAR' THEN CASE WHEN regexp_matches({s}, '{NUMERIC}') THEN TRY_CAST({s} AS DOUBLE) "
            f"WHEN regexp_matches({s}, '{SPECIAL}') THEN TRY_CAST({s} AS DOUBLE) END END")


def enum(j: str, allowed: list[str], default: str) -> str:
    s = strip_sql(jstr(j))
    lst = ", ".join(f"'{a}'" for a in allowed)
    return f"CASE WHEN {jt(j)} = 'VARCHAR' AND {s} IN ({lst}) THEN {s} ELSE '{default}' END"


def score(j: str) -> str:
    d = to_float(j)
    return (f"CASE WHEN ({d}) IS NOT NULL AND NOT isnan({d}) AND NOT isinf({d}) "
            f"THEN CAST(least(5.0::DOUBLE, greatest(0.0::DOUBLE, round_even(({d})::DOUBLE, 0))) AS INTEGER) ELSE 0 END")


def falsy_text(j: str, n: int) -> str:
    return f"CASE WHEN {truthy(j)} THEN substr({pystr(j)}, 1, {n}) ELSE '' END"


def validated_cte(src: str) -> list[str]:
    ex = "json_extract(obj, '$.extraction')"
    qs = "json_extract(obj, '$.quality_scores')"
    ctes = [
        f"v1 AS (SELECT *, {strip_sql('reply')} AS _s FROM {src})",
        f"v2 AS (SELECT *, CASE WHEN regexp_extract(_s, '{FENCE}', 1) <> '' THEN regexp_extract(_s, '{FENCE}', 1) ELSE _s END AS _t FROM v1)",
        "v3 AS (SELECT *, strpos(_t, '{') AS _st, strpos(reverse(_t), '}') AS _bk FROM v2)",
        "v4 AS (SELECT *, _st > 0 AND _bk > 0 AS _found, CASE WHEN _st > 0 AND _bk > 0 "
        "THEN '[' || substr(_t, _st, greatest(length(_t) - _bk + 1 - _st + 1, 0)) || ']' END AS _arr FROM v3)",
        "v5 AS (SELECT *, CASE WHEN json_valid(_arr) AND json_array_length(_arr) = 1 THEN json_extract(_arr, '$[0]') END AS obj FROM v4)",
        f"v6 AS (SELECT *, CASE WHEN {jt(ex)} = 'OBJECT' THEN {ex} END AS _ex, CASE WHEN {jt(qs)} = 'OBJECT' THEN {qs} END AS _qs, "
        f"({truthy(ex)} AND coalesce({jt(ex)}, '') <> 'OBJECT') OR ({truthy(qs)} AND coalesce({jt(qs)}, '') <> 'OBJECT') AS _bad0 FROM v5)",
    ]
    dim_cols = []
    dim_bad = []
    for d in S.DIMENSIONS:
        q = f"json_extract(_qs, '$.{d}')"
        dim_cols.append(f"CASE WHEN {jt(q)} = 'OBJECT' THEN {q} END AS _q_{d}")
        dim_bad.append(f"({truthy(q)} AND coalesce({jt(q)}, '') <> 'OBJECT')")
    pl = "json_extract(_ex, '$.preferred_locations')"
    items = (f"CASE WHEN NOT {truthy(pl)} THEN []::VARCHAR[] "
             f"WHEN {jt(pl)} = 'ARRAY' THEN list_transform(json_extract({pl}, '$[*]'), lambda x: {strip_sql(pystr('x'))}) "
             f"WHEN {jt(pl)} = 'VARCHAR' THEN list_transform(regexp_extract_all({jstr(pl)}, '(?s).'), lambda c: {strip_sql('c')}) "
             f"WHEN {jt(pl)} = 'OBJECT' THEN list_transform(list_sort(json_keys({pl})), lambda k: {strip_sql('k')}) END")
    ctes.append(f"v7 AS (SELECT *, {', '.join(dim_cols)}, {items} AS _items FROM v6)")
    ctes.append(f"v8 AS (SELECT *, _bad0 OR {' OR '.join(dim_bad)} OR ({truthy(pl)} AND _items IS NULL) AS _bad, "
                f"coalesce(list_filter(_items, lambda x: x <> ''), []::VARCHAR[]) AS _locs FROM v7)")
    b = "json_extract(_ex, '$.budget_range')"
    mn = f"json_extract({b}, '$.min_lakhs')"
    mx = f"json_extract({b}, '$.max_lakhs')"
    lo = f"(CASE WHEN {mn} IS NULL THEN 0.0::DOUBLE ELSE {to_float(mn)} END)"
    hi = f"(CASE WHEN {mx} IS NULL THEN {lo} ELSE {to_float(mx)} END)"
    ctes.append(f"v9 AS (SELECT *, {lo} AS _lo, {hi} AS _hi, coalesce({jt(b)} = 'OBJECT', false) AS _bobj FROM v8)")
    good = "(_bobj AND _lo IS NOT NULL AND _hi IS NOT NULL AND NOT isnan(_lo) AND NOT isnan(_hi) AND NOT (_lo <= 0 AND _hi <= 0))"
    status = ("CASE WHEN NOT _found THEN 'no_json' WHEN obj IS NULL THEN 'bad_json' "
              "WHEN _bad THEN 'bad_shape' ELSE 'ok' END")
    sel = [
        "*", f"{status} AS parse_status",
        f"{enum("json_extract(_ex, '$.unit_configuration')", S.UNIT_CONFIGS, S.DEFAULT_UNIT)} AS unit_configuration",
        f"CASE WHEN {good} THEN least(_lo, _hi) END AS budget_min",
        f"CASE WHEN {good} THEN greatest(_lo, _hi) END AS budget_max",
        f"{enum("json_extract(_ex, '$.timeline')", S.TIMELINES, S.DEFAULT_TIMELINE)} AS timeline",
        "_locs AS preferred_locations",
        f"{enum("json_extract(_ex, '$.site_visit_outcome')", S.SITE_VISIT_OUTCOMES, S.DEFAULT_VISIT)} AS site_visit_outcome",
        f"{enum("json_extract(obj, '$.last_stage_reached')", S.LAST_STAGES, S.DEFAULT_STAGE)} AS last_stage_reached",
        f"{enum("json_extract(obj, '$.recommended_next_action')", S.ACTIONS, S.DEFAULT_ACTION)} AS recommended_next_action",
        f"{falsy_text("json_extract(obj, '$.next_action_reason')", S.ACTION_REASON_MAX)} AS next_action_reason",
        f"{falsy_text("json_extract(obj, '$.summary')", S.SUMMARY_MAX)} AS summary",
    ]
    for d in S.DIMENSIONS:
        sel.append(f"{score(f"json_extract(_q_{d}, '$.score')")} AS {d}_score")
        sel.append(f"{falsy_text(f"json_extract(_q_{d}, '$.reason')", S.REASON_MAX)} AS {d}_reason")
    ctes.append(f"validated AS (SELECT {', '.join(sel)} FROM v9)")
    return ctes
