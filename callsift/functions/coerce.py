"""Model reply -> typed analysis struct, with native variant expressions.

Semantics follow the reference's Python validation step by step:

* the JSON is cut from the reply (optional ``` fence, first '{' .. last '}');
* it must parse as exactly one JSON object, else ``bad_json``;
* sections that are missing or falsy become empty, sections of another
  non-empty type make the whole record ``bad_shape``;
* enums, scores, the budget union and the locations list are coerced as the
  reference coerces them (exact or stripped enum, half-even rounded clamped
  score, min/max budget with its swap and "not discussed" rules, ...).

Everything is a Catalyst expression over ``variant`` values, so it runs in
whole-stage codegen with no Python worker.  Known divergences are listed in
README.md (Python ``float('1_0')``, NaN/duplicate-key JSON, Python repr of
nested values, object-key order of a locations object).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from .text import PY_SPACE, col_, pystrip, pystrip_long

FENCE_RE = rf"(?s)```(?:json)?{PY_SPACE}*(\{{.*\}}){PY_SPACE}*```"
# A float() literal of Python that is finite (digits, optional fraction, exponent)
NUMERIC_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPECIAL_FLOAT_RE = r"(?i)^[+-]?(inf|infinity|nan)$"
_INT_TYPES = ["TINYINT", "SMALLINT", "INT", "BIGINT"]


# --------------------------------------------------------------------------- V1
def cut_steps(reply) -> list[dict[str, Column]]:
    """The cut of a reply as steps, each over the columns of the one before; the last gives ``_found`` and ``_text``.

    Replies can be long, so a step looks at each text once and the plain cases (no white space at the ends, no fence, a text
    that is the object already) are told by looking at the ends or by a byte search; only the others are trimmed, matched or cut.
    """
    t = F.col("_unfenced")
    found = t.contains("{") & t.contains("}")
    start = F.instr(t, "{")
    end = F.length(t) - F.instr(F.reverse(t), "}") + 1
    cut = F.substring(t, start, F.greatest(end - start + 1, F.lit(0)))
    fenced = F.col("_fenced")
    return [
        {"_stripped": pystrip_long(reply)},
        {"_fenced": F.when(F.col("_stripped").contains("```"), F.regexp_extract("_stripped", FENCE_RE, 1)).otherwise(F.lit(""))},
        {"_unfenced": F.when(fenced != "", fenced).otherwise(F.col("_stripped"))},
        {"_found": found, "_text": F.when(t.startswith("{") & t.endswith("}"), t).when(found, cut)},
    ]


def cut_json(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add (_found, _text): the candidate JSON text of each reply.

    ``_found`` is false when no '{' or no '}' is present (status no_json).
    """
    out = df
    for cols in cut_steps(reply):
        out = with_boundary(out, cols)
    return out.select(*df.columns, "_found", "_text")


# --------------------------------------------------------------------------- V2
def parse_steps(text) -> list[dict[str, Column]]:
    """Steps that give ``_obj``: the variant of the text when it is exactly one JSON value, else NULL.

    ``try_parse_json`` ignores trailing content, so the text is wrapped in an
    array and the array must hold exactly one element.
    """
    second = vget("_array", "$[1]")
    return [{"_array": F.try_parse_json(F.concat(F.lit("["), col_(text), F.lit("]")))},
            {"_obj": F.when(second.isNull(), vget("_array", "$[0]"))}]


# ------------------------------------------------------------------ helpers
def vtype(v) -> Column:
    return F.schema_of_variant(col_(v))


def vget(v, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(col_(v), path, typ)


def is_obj(v) -> Column:
    return vtype(v).startswith("OBJECT")


def is_num(v) -> Column:
    t = vtype(v)
    return t.isin(*_INT_TYPES, "DOUBLE", "FLOAT") | t.startswith("DECIMAL")


def truthy(v) -> Column:
    """Python truthiness of a JSON value; a missing value (SQL NULL) is falsy."""
    t = vtype(v)
    return F.coalesce(
        F.when(t == "VOID", F.lit(False))
        .when(t == "BOOLEAN", vget(v, "$", "boolean"))
        .when(is_num(v), vget(v, "$", "double") != 0)
        .when(t == "STRING", F.length(vget(v, "$", "string")) > 0)
        .when(t.startswith("ARRAY"), F.array_size(vget(v, "$", "array<variant>")) > 0)
        .when(t.startswith("OBJECT"), F.size(vget(v, "$", "map<string,variant>")) > 0),
        F.lit(False))


def pystr(v) -> Column:
    """str() of a JSON-loaded value, for the value kinds replies carry."""
    t = vtype(v)
    integral = t.isin(*_INT_TYPES) | (t.startswith("DECIMAL") & t.endswith(",0)"))
    return (F.when(t == "VOID", F.lit("None"))
            .when(t == "STRING", vget(v, "$", "string"))
            .when(t == "BOOLEAN", F.when(vget(v, "$", "boolean"), F.lit("True")).otherwise(F.lit("False")))
            .when(integral, vget(v, "$", "string"))
            .when(is_num(v), vget(v, "$", "double").cast("string"))
            .otherwise(F.to_json(col_(v))))


def falsy_text(v, limit: int) -> Column:
    """str(x or '')[:limit]; a string is read once, the empty one gives itself."""
    text = F.when(vtype(v) == "STRING", vget(v, "$", "string")).when(truthy(v), pystr(v))
    return F.coalesce(F.substring(text, 1, limit), F.lit(""))


def to_float(v) -> Column:
    """float(x) for a JSON value; NULL where Python's float() raises."""
    t = vtype(v)
    s = pystrip(vget(v, "$", "string"))
    from_str = (F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))
                .when(s.rlike(SPECIAL_FLOAT_RE), s.try_cast("double")))
    return (F.when(t == "BOOLEAN", F.when(vget(v, "$", "boolean"), F.lit(1.0)).otherwise(F.lit(0.0)))
            .when(is_num(v), vget(v, "$", "double"))
            .when(t == "STRING", from_str))


# --------------------------------------------------------------------------- V3
def coerce_enum(v, allowed: list[str], default: str) -> Column:
    s = pystrip(vget(v, "$", "string"))
    return F.when((vtype(v) == "STRING") & s.isin(*allowed), s).otherwise(F.lit(default))


# --------------------------------------------------------------------------- V4
def coerce_score(v) -> Column:
    """int(round(float(x))) clamped to 0..5; any failure, NaN or inf gives 0."""
    d = to_float(v)
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    r = F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.bround(d, 0)))
    return F.when(ok, r).otherwise(F.lit(0.0)).cast("int")


def coerce_score_text(c) -> Column:
    """V4 over a plain string column (scores stored as text)."""
    s = pystrip(col_(c))
    d = F.when(s.rlike(NUMERIC_RE), s.try_cast("double"))
    ok = d.isNotNull() & (F.abs(d) != float("inf"))
    r = F.least(F.lit(5.0), F.greatest(F.lit(0.0), F.bround(d, 0)))
    return F.when(ok, r).otherwise(F.lit(0.0)).cast("int")


# --------------------------------------------------------------------------- V5
def coerce_budget(v) -> Column:
    """Budget union -> struct<min_lakhs,max_lakhs>, NULL for "not_discussed".

    Missing min -> 0; missing max -> min; a present value that float() rejects
    (JSON null, list, non-numeric text) -> not discussed; both <= 0 -> not
    discussed; reversed bounds are swapped.
    """
    return _budget_from_parts(v, vget(v, "$.min_lakhs"), vget(v, "$.max_lakhs"))


# --------------------------------------------------------------------------- V6
def clean_locations(v) -> tuple[Column, Column]:
    """(list, bad): stripped non-blank str() of whatever is iterated.

    A list yields its elements, a string its characters, an object its keys;
    a non-zero number or ``true`` cannot be iterated (bad shape).
    """
    t = vtype(v)
    elems = vget(v, "$", "array<variant>")
    from_array = F.transform(elems, lambda x: pystrip(pystr(x)))
    from_string = F.transform(F.regexp_extract_all(vget(v, "$", "string"), F.lit("(?s)."), 0), lambda c: pystrip(c))
    from_object = F.transform(F.map_keys(vget(v, "$", "map<string,variant>")), lambda k: pystrip(k))
    items = (F.when(~truthy(v), F.array().cast("array<string>"))
             .when(t.startswith("ARRAY"), from_array)
             .when(t == "STRING", from_string)
             .when(t.startswith("OBJECT"), from_object))
    cleaned = F.filter(items, lambda x: x != "")
    bad = truthy(v) & items.isNull()
    return F.coalesce(cleaned, F.array().cast("array<string>")), bad


# ------------------------------------------------------------- V9 / V10
def _section(v) -> tuple[Column, Column]:
    """(value, bad): falsy -> NULL (empty), object -> itself, else bad shape."""
    return F.when(is_obj(v), col_(v)), ~is_obj(v) & truthy(v)


def with_boundary(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add ``cols`` through a one-row generator (``inline`` of a 1-element array).

    The optimizer pushes a filter on a derived column down through every
    projection by substituting the column's definition at each level; on the
    validation chain, where each step reads the previous ones several times,
    that substitution grows exponentially.  A generator output cannot be
    substituted, so filters on these columns stay above this point, while the
    rows still stream through one pipelined stage (no shuffle, no cache).
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


_TMP = ["_found", "_obj", "_exr", "_qsr", "_ex", "_qs", "_bad", "_locs", "_locr", "_budr",
        "_unit", "_tl", "_visit", "_stage", "_act", "_nar", "_sum"]


_STAGES: dict = {}


def validate_replies(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``parse_status`` (ok / no_reply / no_json / bad_json / bad_shape) and ``analysis``.

    ``analysis`` is the typed struct of schema.ANALYSIS, NULL unless ok.  Each
    step is its own projection over named columns: every JSON path is looked
    up once per row and later steps refer to the looked-up value by column,
    which keeps the generated code linear in the number of fields.  The step
    expressions refer to columns by name only, so they are built once per JVM
    and reused by every plan (building them costs thousands of gateway calls).
    """
    from pyspark import SparkContext
    key = (id(SparkContext._active_spark_context), reply)
    if key not in _STAGES:
        _STAGES[key] = _validation_stages(reply)
    out = df
    for boundary, cols in _STAGES[key]:
        out = with_boundary(out, cols) if boundary else out.withColumns(cols)
    drop = [c for c in out.columns if c not in df.columns and c not in ("parse_status", "analysis")]
    return out.drop(*drop)


def _validation_stages(reply: str) -> list[tuple[bool, dict[str, Column]]]:
    """(through a boundary?, columns) for each validation step, in order."""
    stages = []
    stages += [(True, cols) for cols in cut_steps(reply) + parse_steps("_text")]
    obj = F.col("_obj")
    stages.append((False, {
        "_exr": vget(obj, "$.extraction"), "_qsr": vget(obj, "$.quality_scores"),
        "_stage": vget(obj, "$.last_stage_reached"), "_act": vget(obj, "$.recommended_next_action"),
        "_nar": vget(obj, "$.next_action_reason"), "_sum": vget(obj, "$.summary")}))
    ex, ex_bad = _section("_exr")
    qs, qs_bad = _section("_qsr")
    stages.append((False, {"_ex": ex, "_qs": qs, "_bad": ex_bad | qs_bad}))
    leaves = {"_unit": vget("_ex", "$.unit_configuration"), "_budr": vget("_ex", "$.budget_range"),
              "_tl": vget("_ex", "$.timeline"), "_locr": vget("_ex", "$.preferred_locations"),
              "_visit": vget("_ex", "$.site_visit_outcome")}
    for d in S.DIMENSIONS:
        leaves[f"_qr_{d}"] = vget("_qs", f"$.{d}")
    stages.append((True, leaves))
    bad = F.col("_bad")
    dims = {}
    for d in S.DIMENSIONS:
        q, q_bad = _section(f"_qr_{d}")
        dims[f"_q_{d}"] = q
        bad = bad | q_bad
    stages.append((False, {**dims, "_bad": bad}))
    stages.append((True, {**{f"_s_{d}": vget(f"_q_{d}", "$.score") for d in S.DIMENSIONS},
                          **{f"_r_{d}": vget(f"_q_{d}", "$.reason") for d in S.DIMENSIONS},
                          "_bmin": vget("_budr", "$.min_lakhs"), "_bmax": vget("_budr", "$.max_lakhs")}))
    # final values in three groups, each through its own boundary, so no single
    # generated method has to hold the whole record
    stages.append((True, {
        "_o_unit": coerce_enum("_unit", S.UNIT_CONFIGS, S.DEFAULT_UNIT),
        "_o_tl": coerce_enum("_tl", S.TIMELINES, S.DEFAULT_TIMELINE),
        "_o_visit": coerce_enum("_visit", S.SITE_VISIT_OUTCOMES, S.DEFAULT_VISIT),
        "_o_stage": coerce_enum("_stage", S.LAST_STAGES, S.DEFAULT_STAGE),
        "_o_act": coerce_enum("_act", S.ACTIONS, S.DEFAULT_ACTION),
        "_budget": _budget_from_parts("_budr", "_bmin", "_bmax")}))
    locs, locs_bad = clean_locations("_locr")
    stages.append((True, {"_locs": locs, "_bad2": F.col("_bad") | locs_bad,
                          **{f"_o_s_{d}": coerce_score(f"_s_{d}") for d in S.DIMENSIONS}}))
    stages.append((True, {**{f"_o_r_{d}": falsy_text(f"_r_{d}", S.REASON_MAX) for d in S.DIMENSIONS},
                          "_o_nar": falsy_text("_nar", S.ACTION_REASON_MAX),
                          "_o_sum": falsy_text("_sum", S.SUMMARY_MAX)}))
    analysis = F.struct(
        F.struct(
            F.col("_o_unit").alias("unit_configuration"), F.col("_budget").alias("budget_range"),
            F.col("_o_tl").alias("timeline"), F.col("_locs").alias("preferred_locations"),
            F.col("_o_visit").alias("site_visit_outcome"),
        ).alias("extraction"),
        F.struct(*[F.struct(F.col(f"_o_s_{d}").alias("score"), F.col(f"_o_r_{d}").alias("reason")).alias(d)
                   for d in S.DIMENSIONS]).alias("quality_scores"),
        F.col("_o_stage").alias("last_stage_reached"), F.col("_o_act").alias("recommended_next_action"),
        F.col("_o_nar").alias("next_action_reason"), F.col("_o_sum").alias("summary"),
    )
    status = (F.when(F.col(reply).isNull(), F.lit("no_reply"))
              .when(~F.col("_found"), F.lit("no_json"))
              .when(obj.isNull(), F.lit("bad_json"))
              .when(F.col("_bad2"), F.lit("bad_shape"))
              .otherwise(F.lit("ok")))
    stages.append((False, {"_status": status}))
    stages.append((True, {"parse_status": F.col("_status"),
                          "analysis": F.when(F.col("_status") == "ok", analysis)}))
    return stages


def _budget_from_parts(b, mn, mx) -> Column:
    lo = F.when(col_(mn).isNull(), F.lit(0.0)).otherwise(to_float(mn))
    hi = F.when(col_(mx).isNull(), lo).otherwise(to_float(mx))
    good = (is_obj(b) & lo.isNotNull() & hi.isNotNull() & ~F.isnan(lo) & ~F.isnan(hi)
            & ~((lo <= 0) & (hi <= 0)))
    return F.when(good, F.struct(F.least(lo, hi).alias("min_lakhs"), F.greatest(lo, hi).alias("max_lakhs")))


# ----------------------------------------------------------------- P14
def score_quarters(analysis) -> Column:
    """Sum of the four 0-5 scores: the overall score in quarter points (exact)."""
    qs = col_(analysis)["quality_scores"]
    return sum((qs[d]["score"] for d in S.DIMENSIONS[1:]), qs[S.DIMENSIONS[0]]["score"]).cast("int")


def overall_score(analysis) -> Column:
    """round(sum / 4, 2); quarters are exact, so the rounding is a no-op."""
    return score_quarters(analysis) / F.lit(4.0)
