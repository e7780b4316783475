"""Rules of the call store: merge by call_id, edits, bulk reassignment.

``partition_store`` applies them to the stored table, date by date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import schema as S
from ..functions.coerce import (clean_locations, coerce_budget, coerce_score_text, falsy_text, is_obj, overall_score, score_quarters,
                                to_float, vget, vtype, with_boundary)
from ..functions.text import pystrip, transcript_hash

UPDATE_COLS = ["analysis", "overall_score", "score_quarters", "transcript_hash"]
KEEP_COLS = ["telecaller_id", "telecaller_name", "lead_id", "lead_name", "duration_sec", "ts", "transcript"]


def merge_calls(store: DataFrame, batch: DataFrame, batch_ts: Column, commit: str | None = None) -> DataFrame:
    """Upsert by call_id (M1 M4, Q11).

    New keys insert the whole batch row; an existing key takes analysis,
    overall score and hash from the batch but keeps its transcript, names,
    timestamp (hence its partition) and created_at.  With ``commit`` the store's columns created_in and
    changed_in are kept up: the commit that inserted a call and the last one that changed it.
    """
    marks = ["created_in", "changed_in"] if commit else []
    s = store.select("call_id", *KEEP_COLS, *UPDATE_COLS, "created_at", *marks).alias("s")
    b = batch.select("call_id", *KEEP_COLS, *UPDATE_COLS).alias("b")
    j = s.join(b, F.col("s.call_id") == F.col("b.call_id"), "full_outer")
    cols = [F.coalesce(F.col("s.call_id"), F.col("b.call_id")).alias("call_id")]
    hit = F.col("b.call_id").isNotNull()
    for c in KEEP_COLS:
        cols.append(F.when(F.col("s.call_id").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    for c in UPDATE_COLS:
        cols.append(F.when(hit, F.col(f"b.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    cols.append(F.coalesce(F.col("s.created_at"), batch_ts).alias("created_at"))
    if commit:
        cols += [F.coalesce(F.col("s.created_in"), F.lit(commit)).alias("created_in"),
                 F.when(hit, F.lit(commit)).otherwise(F.col("s.changed_in")).alias("changed_in")]
    out = j.select(*cols)
    return out.withColumn("call_date", F.to_date("ts"))


# ---------------------------------------------------------------- edits
# Editable leaves and how a new value is coerced (the reference writes any value
# unvalidated; we keep the typed store valid and quarantine what does not fit).
EDITABLE = {
    "extraction.unit_configuration": S.UNIT_CONFIGS,
    "extraction.timeline": S.TIMELINES,
    "extraction.site_visit_outcome": S.SITE_VISIT_OUTCOMES,
    "last_stage_reached": S.LAST_STAGES,
    "recommended_next_action": S.ACTIONS,
    **{f"quality_scores.{d}.score": "score" for d in S.DIMENSIONS},
}


TEXTS = {**{f"quality_scores.{d}.reason": S.REASON_MAX for d in S.DIMENSIONS}, "next_action_reason": S.ACTION_REASON_MAX, "summary": S.SUMMARY_MAX}
BUDGET, LOCATIONS = "extraction.budget_range", "extraction.preferred_locations"
#: Every leaf of the analysis, as it may be named in an edit; the budget is one leaf, an object or "not_discussed".
PATHS = [*EDITABLE, *TEXTS, BUDGET, LOCATIONS]


def coerced_edits(edits: DataFrame) -> DataFrame:
    """``edits`` with _ok (may the value be written to the field?) and the value as _text, _budget or _locs.

    ``value`` is a variant, or a text; for the budget and the locations a text is read as JSON.  Values are coerced as
    in a model's reply (V3-V8); what the reply's rules would replace by a default is not ok here: unknown names,
    numbers that are none, bounds that are none, a list that is none.
    """
    f, raw = F.col("field"), F.col("value")
    if edits.schema["value"].dataType == T.VariantType():
        variant, text = raw, F.to_json("value")
    else:
        variant, text = F.when(f.isin(BUDGET, LOCATIONS), F.coalesce(F.try_parse_json(raw), raw.cast("variant"))).otherwise(raw.cast("variant")), raw
    # the check is not pushed below its inputs, where it would repeat their expressions
    read = with_boundary(edits, {"_v": variant, "_order": text})
    read = with_boundary(read, {"_value": pystrip(vget("_v", "$", "string")), "_kind": vtype("_v"), "_lo": vget("_v", "$.min_lakhs"), "_hi": vget("_v", "$.max_lakhs")})
    plain = F.col("_kind").isNotNull() & ~F.col("_kind").startswith("ARRAY") & ~F.col("_kind").startswith("OBJECT")
    v = F.col("_value")
    ok = f.isin(*TEXTS) & plain
    for path, allowed in EDITABLE.items():
        fits = v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") if allowed == "score" else v.isin(*allowed)
        ok = ok | ((f == path) & plain & fits)
    bound = lambda c: F.col(c).isNull() | ~F.isnan(F.coalesce(to_float(c), F.lit(float("nan"))))
    ok = ok | ((f == BUDGET) & ((v == "not_discussed") | (is_obj("_v") & bound("_lo") & bound("_hi"))))
    ok = ok | ((f == LOCATIONS) & F.col("_kind").startswith("ARRAY"))
    out = with_boundary(read, {
        "_ok": F.coalesce(ok, F.lit(False)),
        "_text": F.when(f.isin(*EDITABLE), v).when(f == "summary", falsy_text("_v", S.SUMMARY_MAX)).when(f.isin(*TEXTS), falsy_text("_v", S.REASON_MAX)),
        "_budget": F.when(f == BUDGET, coerce_budget("_v")),
        "_locs": F.when(f == LOCATIONS, clean_locations("_v")[0])})
    return out.drop("_v", "_value", "_kind", "_lo", "_hi")


def latest_edits(edits: DataFrame) -> DataFrame:
    """The latest of the coerced edits per (call_id, field) (W3) as a grouped max_by: combines map-side,
    so many edits of one call never meet in one task.  Edits of one time are ordered by
    ``edit_id`` where there is one, then by value."""
    order = F.struct("edited_at", *[c for c in ["edit_id"] if c in edits.columns], "_order")
    return edits.groupBy("call_id", "field").agg(F.max_by(F.struct("_text", "_budget", "_locs"), order).alias("_e")).select("call_id", "field", "_e.*")


def apply_edits(store: DataFrame, edits: DataFrame, keep_edit_columns: bool = False) -> tuple[DataFrame, DataFrame]:
    """(updated store, quarantine) after applying the latest valid edit per field (M2 M3).

    Every edit is checked before the latest is chosen, so an invalid one hides no earlier
    valid one; every edit that is not applicable is quarantined with its reason.

    Edits are pivoted to one row per call (a fixed set of columns, one per
    path), left-joined to the store, written into the struct, which is built once, and the overall score is
    recomputed (P14).  Unknown calls, unknown paths and values that do not coerce go to the quarantine.
    """
    # one membership join splits known from unknown calls (the store's keys only)
    member = edits.join(store.select("call_id").withColumn("_known", F.lit(True)), "call_id", "left")
    known = member.filter(F.col("_known").isNotNull()).drop("_known")
    unknown = (member.filter(F.col("_known").isNull()).drop("_known")
               .withColumn("reason", F.lit("call not found")))
    flagged = coerced_edits(known)
    bad = flagged.filter(~F.col("_ok")).select(*edits.columns, F.lit("invalid field or value").alias("reason"))
    good = latest_edits(flagged.filter("_ok"))
    value = {BUDGET: F.struct(F.lit(True).alias("given"), F.col("_budget").alias("budget")), LOCATIONS: F.col("_locs")}
    pivot = good.groupBy("call_id").agg(
        *[F.max(F.when(F.col("field") == p, value.get(p, F.col("_text")))).alias(_col(p)) for p in PATHS])
    j = store.join(pivot.withColumn("_edited", F.lit(True)), "call_id", "left")
    scores = {p: coerce_score_text(F.col(_col(p))) for p, allowed in EDITABLE.items() if allowed == "score"}
    j = with_boundary(j, {f"{_col(p)}_n": F.when(F.col(_col(p)).isNotNull(), c) for p, c in scores.items()})
    new = {p: (lambda old, c=F.col(f"{_col(p)}_n" if p in scores else _col(p)): F.coalesce(c, old)) for p in PATHS}
    new[BUDGET] = lambda old: F.when(F.col(_col(BUDGET)).isNotNull(), F.col(_col(BUDGET))["budget"]).otherwise(old)
    edited = _edited_struct(S.ANALYSIS, F.col("analysis"), new)
    out = with_boundary(j, {"_analysis": F.when(F.col("analysis").isNotNull(), edited)})
    out = out.withColumn("analysis", F.col("_analysis")).drop("_analysis", *[f"{_col(p)}_n" for p in scores])
    out = out.withColumns({"score_quarters": score_quarters("analysis"), "overall_score": overall_score("analysis"),
                           "edited": F.coalesce(F.col("_edited"), F.lit(False))})
    out = out.drop("_edited")
    if not keep_edit_columns:
        out = out.drop(*[_col(p) for p in PATHS])
    return out, unknown.unionByName(bad.select(*unknown.columns))


def edit_column(path: str) -> str:
    """Name of the column holding the applied new value of ``path`` (keep_edit_columns=True)."""
    return _col(path)


def _col(path: str) -> str:
    return "_e_" + path.replace(".", "__")


def _edited_struct(schema: T.StructType, c: Column, new: dict[str, Callable[[Column], Column]], prefix: str = "") -> Column:
    """The struct ``c`` built once, each leaf as its entry in ``new`` makes it of the old value."""
    fields = []
    for f in schema.fields:
        path = prefix + f.name
        if path in new:
            value = new[path](c[f.name])
        elif any(p.startswith(path + ".") for p in new):
            value = _edited_struct(f.dataType, c[f.name], new, path + ".")
        else:
            value = c[f.name]
        fields.append(value.alias(f.name))
    return F.struct(*fields)


def reassign(store: DataFrame, selection: DataFrame, telecaller_id: str, telecaller_name: str) -> DataFrame:
    """Bulk action: move the selected calls to another telecaller.

    A keyed left join with the selection (its size decides broadcast or
    sort-merge at run time); unselected calls pass unchanged.
    """
    sel = selection.select("call_id").distinct().withColumn("_sel", F.lit(True))
    j = store.join(sel, "call_id", "left")
    hit = F.coalesce(F.col("_sel"), F.lit(False))
    return j.withColumns({"telecaller_id": F.when(hit, F.lit(telecaller_id)).otherwise(F.col("telecaller_id")),
                          "telecaller_name": F.when(hit, F.lit(telecaller_name)).otherwise(F.col("telecaller_name"))}
                         ).drop("_sel")


def foreign_hashes(store: DataFrame) -> DataFrame:
    """Stored calls whose hash is not that of their transcript (Q11): a call that was sent again keeps its transcript and takes the new hash."""
    return store.filter(~F.col("transcript_hash").eqNullSafe(transcript_hash("transcript")))
