"""DuckDB SQL for the derived call data (FIXTURES.md section 3), used by the oracles.

The driver pre-registers the parquet tables as views; these CTEs rebuild the
same calls / replies from them so every oracle query is self-contained.
DuckDB's RE2 regexes and string literals keep backslashes literally.
"""

from __future__ import annotations

from ..sources.fixtures import PHRASES

PY_SPACE_RE2 = r"[\t\n\x0B\f\r \x1c-\x1f\x85\p{Z}]"


def strip_sql(x: str) -> str:
    """Python str.strip() in DuckDB."""
    return f"regexp_replace({x}, '^{PY_SPACE_RE2}+|{PY_SPACE_RE2}+$', '', 'g')"


def hash_sql(x: str) -> str:
    return f"substr(sha256({strip_sql(x)}), 1, 32)"


def pad_sql(x: str, width: int) -> str:
    """Zero-padded decimal text; longer numbers stay whole."""
    return f"lpad(CAST({x} AS VARCHAR), greatest({width}, CAST(length(CAST({x} AS VARCHAR)) AS INTEGER)), '0')"


_phrase_rows = ", ".join(f"({p}, '{s}', '{t}')" for p, s, t in PHRASES)

CTE = {
    "phrases": f"phrases(pid, speaker, phrase) AS (VALUES {_phrase_rows})",
    "turns": """turns AS (
  SELECT c.conv_id, c.turn, c.turn*12 AS start_sec, c.turn*12 + 5 + length(c.text) % 7 AS end_sec,
         coalesce(p.speaker, 'System') AS speaker, coalesce(p.phrase, replace(c.text, chr(10), ' ')) AS utterance
  FROM conversations c LEFT JOIN phrases p ON p.pid =
    CASE c.role WHEN 'assistant' THEN (c.conv_id*7 + c.turn*3) % 10
                WHEN 'user' THEN 10 + (c.conv_id*3 + c.turn*7) % 10 END)""",
    "lines": f"""lines AS (
  SELECT conv_id, turn, end_sec,
    '[' || {pad_sql('CAST((start_sec - start_sec % 60) / 60 AS INT)', 2)} || ':' || lpad(CAST(start_sec % 60 AS INT) || '', 2, '0')
    || '-' || {pad_sql('CAST((end_sec - end_sec % 60) / 60 AS INT)', 2)} || ':' || lpad(CAST(end_sec % 60 AS INT) || '', 2, '0')
    || '] ' || speaker || ': ' || utterance AS line
  FROM turns)""",
    "tx": """tx AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS transcript, max(end_sec) AS duration_sec
  FROM lines GROUP BY conv_id)""",
    "calls": f"""calls AS (
  SELECT 'CALL_' || {pad_sql('x.conv_id', 6)} AS call_id,
         'TC_' || {pad_sql('s.s_suppkey', 3)} AS telecaller_id, s.s_name AS telecaller_name,
         'LEAD_' || CAST(k.c_custkey AS VARCHAR) AS lead_id, k.c_name AS lead_name,
         x.duration_sec, e.ts, x.transcript, x.conv_id
  FROM tx x JOIN supplier s ON s.s_suppkey = x.conv_id % (SELECT max(s_suppkey) + 1 FROM supplier)
            JOIN customer k ON k.c_custkey = (x.conv_id * 17) % (SELECT max(c_custkey) + 1 FROM customer)
            JOIN events e ON e.event_id = x.conv_id)""",
    "bodies": """bodies AS (
  SELECT conv_id, '{"extraction": {"unit_configuration": '
   || CASE WHEN conv_id % 7 = 0 THEN '" 3BHK "' WHEN conv_id % 7 = 1 THEN '"3bhk"' WHEN conv_id % 7 = 2 THEN '4' WHEN conv_id % 7 = 3 THEN '"villa"' ELSE '"2BHK"' END
   || ', "budget_range": ' || CASE conv_id % 9 WHEN 0 THEN '"not_discussed"' WHEN 1 THEN '{"min_lakhs": 70, "max_lakhs": 55}' WHEN 2 THEN '{"min_lakhs": "42"}'
        WHEN 3 THEN '{"min_lakhs": null, "max_lakhs": 60}' WHEN 4 THEN '{"max_lakhs": 60}' WHEN 5 THEN '{"min_lakhs": 0, "max_lakhs": 0}'
        WHEN 6 THEN 'null' WHEN 7 THEN '{"min_lakhs": -5, "max_lakhs": 30.5}' ELSE '[40, 50]' END
   || ', "timeline": "' || CASE conv_id % 4 WHEN 0 THEN 'immediate' WHEN 1 THEN '3_to_6_months' WHEN 2 THEN 'soon' ELSE 'exploring' END
   || '", "preferred_locations": ' || CASE conv_id % 6 WHEN 0 THEN '["OMR", " Velachery ", ""]' WHEN 1 THEN 'null' WHEN 2 THEN '[]'
        WHEN 3 THEN '["Guindy", null, 12, true]' WHEN 4 THEN '"OMR"' ELSE '["omr", "OMR"]' END
   || ', "site_visit_outcome": "' || CASE conv_id % 5 WHEN 0 THEN 'committed_with_date' WHEN 1 THEN 'declined' WHEN 2 THEN 'call_cut' WHEN 3 THEN 'committed_no_date' ELSE 'maybe' END
   || '"}, "quality_scores": {"discovery": {"score": ' || CAST(conv_id % 8 - 1 AS VARCHAR) || ', "reason": "asked budget"}, "pitch": {"score": "' || CAST(conv_id % 6 AS VARCHAR)
   || '.5", "reason": null}, "objection_handling": ' || CASE conv_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '{"score": 4}' ELSE '{"score": "4/5"}' END
   || ', "next_step": {"score": true}}, "last_stage_reached": "pitch", "recommended_next_action": "' || CASE conv_id % 2 WHEN 0 THEN 'mark_cold' ELSE 'call later' END
   || '", "summary": "Two sentences. Here."}' AS body
  FROM (SELECT DISTINCT conv_id FROM conversations))""",
    "replies": """replies AS (
  SELECT conv_id, CASE conv_id % 11
      WHEN 0 THEN 'Sure:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```'
      WHEN 1 THEN 'I cannot help'
      WHEN 2 THEN body || ' ' || body
      WHEN 3 THEN '{"extraction": [1], "quality_scores": {}}'
      WHEN 4 THEN '{}'
      WHEN 5 THEN substr(body, 1, length(body) - 9)
      ELSE ' ' || body END AS reply
  FROM bodies)""",
}

DEPS = {
    "phrases": [], "turns": ["phrases"], "lines": ["turns"], "tx": ["lines"], "calls": ["tx"],
    "bodies": [], "replies": ["bodies"],
}


def with_ctes(names: list[str], extra: list[str] | None = None) -> str:
    """WITH clause holding the named fixture CTEs (dependencies first) plus extra CTE texts."""
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [CTE[n] for n in order] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
