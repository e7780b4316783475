"""Registered queries over the committed store, typed edits and detail records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from .. import schema as S
from ..operators import dedup, ingest, metrics, partition_store, rubric, store, views
from ..operators.analysis import analyze, response_record
from ..operators.leaderboard import from_score_counts
from ..session import kept, work_dir
from ..sources import fixtures as FX
from .queries import register, stored_calls
from .queries_ops import INGEST_TS, _doc_calls, _n_conv, _ok_replies, _store_and_batch, latency_rounds


def _root(spark, name: str) -> str:
    return f"{work_dir(spark, name)}/{uuid.uuid4().hex}"


@register("standing_leaderboard")
def q_standing_leaderboard(spark, sf_dir):
    """The leaderboard after five merges (A1 W1 W2 M1), from the store's score counts alone: each merge brings a fifth of the
    calls and sends every second call of the fifth before again with another analysis."""
    ok = _ok_replies(spark, sf_dir)
    _, again = _store_and_batch(spark, sf_dir, ok)
    calls, again = kept(stored_calls(spark, sf_dir, ok), "calls"), kept(again, "again")
    root = _root(spark, "standing")
    for k in range(5):
        resent = again.where((F.col("conv_id") % 5 == k - 1) & (F.col("conv_id") % 2 == 0))
        batch = calls.where(F.col("conv_id") % 5 == k).unionByName(resent, allowMissingColumns=True)
        partition_store.merge(spark, root, batch, F.to_timestamp(F.lit(INGEST_TS)))
    return from_score_counts(partition_store.score_counts(spark, root))


@register("change_feed")
def q_change_feed(spark, sf_dir):
    """Every change of three versions, followed as a stream (X2): a first load, a merge that inserts and re-scores, a batch of edits."""
    old, batch = _store_and_batch(spark, sf_dir)
    root = _root(spark, "feed")
    ts = F.to_timestamp(F.lit(INGEST_TS))
    partition_store.merge(spark, root, old, ts)
    partition_store.merge(spark, root, batch.where(F.col("conv_id") % 3 == 0), ts)
    some = FX.calls(spark, sf_dir).where(F.col("conv_id") % 7 == 0)
    partition_store.edit(spark, root, some.select("call_id", F.lit("quality_scores.discovery.score").alias("field"), F.lit("5").alias("value"), ts.alias("edited_at")))

    def handle(rows: DataFrame, number: int) -> None:
        rows.select("call_id", "change", "score_quarters").write.mode("overwrite").parquet(f"{root}-seen/version={number}")

    partition_store.follow(spark, root, handle, f"{root}-ckpt")
    return spark.read.parquet(f"{root}-seen").select(F.col("version").cast("int").alias("version"), "call_id", "change", "score_quarters")


@register("store_cache_hits")
def q_store_cache_hits(spark, sf_dir):
    """Documents with an odd id looked up among the stored ones (J2), through the store's hash table: no stored text is read."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(_doc_calls(spark, sf_dir), "doc_id")
    none = F.lit(None)
    rows = d.where(F.col("doc_id") % 2 == 0).select(
        "call_id", F.col("source").alias("telecaller_id"), F.col("source").alias("telecaller_name"), F.col("lang").alias("lead_id"), F.col("lang").alias("lead_name"),
        none.cast("long").alias("duration_sec"), F.timestamp_seconds(F.col("doc_id") % 30 * 86400).alias("ts"), F.col("text").alias("transcript"),
        none.cast(S.ANALYSIS).alias("analysis"), none.cast("double").alias("overall_score"), none.cast("int").alias("score_quarters"), "transcript_hash")
    root = _root(spark, "cache")
    partition_store.merge(spark, root, rows, F.to_timestamp(F.lit(INGEST_TS)))
    batch = d.where(F.col("doc_id") % 2 == 1).select("doc_id", "transcript_hash")
    return partition_store.cache_lookup(spark, root, batch).select("doc_id", "cached", "cached_call_id")


@register("response_cached")
def q_response_cached(spark, sf_dir):
    """Response records (S7 J2): every call is sent, the even ones are stored already and answered from the store as ``cached``."""
    old, _ = _store_and_batch(spark, sf_dir)
    root = _root(spark, "responses")
    partition_store.merge(spark, root, old, F.col("b.ts"))
    sent = kept(partition_store.cache_lookup(spark, root, stored_calls(spark, sf_dir).select("call_id", "transcript_hash", "analysis")), "sent")
    known = partition_store.lookup(spark, root, sent.where("cached").select(F.col("cached_call_id").alias("call_id")))
    hits = sent.where("cached").select("cached_call_id").join(known.select(F.col("call_id").alias("cached_call_id"), "analysis"), "cached_call_id")
    out = response_record(hits.select(F.col("cached_call_id").alias("call_id"), F.lit(True).alias("cached"), "analysis").unionByName(
        sent.where("not cached").select("call_id", "cached", "analysis")))
    return out.select("call_id", "cached", F.col("extraction.timeline").alias("timeline"), F.col("quality_scores.discovery.score").alias("discovery_score"),
                      "last_stage_reached", "summary")


@register("hash_consistency")
def q_hash_consistency(spark, sf_dir):
    """Stored calls whose hash is not that of the stored transcript (Q11), after a merge that sent calls again with a longer one."""
    old, batch = _store_and_batch(spark, sf_dir)
    root = _root(spark, "hashes")
    partition_store.merge(spark, root, old, F.col("b.ts"))
    partition_store.merge(spark, root, batch.where(F.col("conv_id") % 3 == 0), F.to_timestamp(F.lit(INGEST_TS)))
    return store.foreign_hashes(partition_store.calls(spark, root)).select("call_id", "transcript_hash")


# ----------------------------------------------------------------- typed edits
def _typed_edits(spark, sf_dir) -> DataFrame:
    """An edit per event: budgets and locations as JSON in every form, reasons and summaries with a document's text."""
    e = FX.table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    docs = FX.table(spark, sf_dir, "documents").select("doc_id", "text")
    e = e.withColumn("doc_id", F.col("event_id") % FX.n_keys(docs, "doc_id")).join(docs, "doc_id", "left")
    eid = F.col("event_id")
    kind, form = eid % 6, F.floor(eid / 6) % 7
    n = (eid % 50 + 1).cast("string")
    budget = (F.when(form == 0, F.concat(F.lit('{"min_lakhs": '), n, F.lit(', "max_lakhs": 60}')))
              .when(form == 1, F.concat(F.lit('{"min_lakhs": 90, "max_lakhs": '), n, F.lit("}")))
              .when(form == 2, F.concat(F.lit('{"min_lakhs": " '), n, F.lit('.5"}'))).when(form == 3, F.lit(" not_discussed"))
              .when(form == 4, F.lit('{"min_lakhs": "abc"}')).when(form == 5, F.lit('{"min_lakhs": 0, "max_lakhs": 0}')).otherwise(F.lit("cheap")))
    places = (F.when(form % 3 == 0, F.concat(F.lit('["OMR", " '), "event_type", F.lit(' ", "", 7]'))).when(form % 3 == 1, F.lit("OMR")).otherwise(F.lit("[]")))
    field = (F.when(kind.isin(0, 5), F.lit(store.BUDGET)).when(kind == 1, F.lit(store.LOCATIONS)).when(kind == 2, F.lit("quality_scores.pitch.reason"))
             .when(kind == 3, F.lit("next_action_reason")).otherwise(F.lit("summary")))
    value = F.when(kind.isin(0, 5), budget).when(kind == 1, places).otherwise(F.col("text"))
    return e.select(F.concat(F.lit("CALL_"), FX.padded(eid % _n_conv(spark, sf_dir), 6)).alias("call_id"), field.alias("field"), value.alias("value"),
                    F.col("ts").cast("timestamp").alias("edited_at"), eid.alias("edit_id"))


@register("apply_typed_edits")
def q_apply_typed_edits(spark, sf_dir):
    """Edits of budget, locations, reasons and summary (M2, V5-V8)."""
    out, _ = store.apply_edits(kept(stored_calls(spark, sf_dir), "stored"), kept(_typed_edits(spark, sf_dir), "edits"))
    a = F.col("analysis")
    ex = a["extraction"]
    return out.select("call_id", ex["budget_range"]["min_lakhs"].alias("budget_min"), ex["budget_range"]["max_lakhs"].alias("budget_max"),
                      F.array_join(ex["preferred_locations"], "|").alias("locations"), F.length(a["quality_scores"]["pitch"]["reason"]).alias("pitch_chars"),
                      F.md5(a["quality_scores"]["pitch"]["reason"]).alias("pitch_md5"), F.md5(a["next_action_reason"]).alias("action_md5"),
                      F.length(a["summary"]).alias("summary_chars"), F.md5(a["summary"]).alias("summary_md5"), "overall_score", "edited")


@register("typed_edit_quarantine")
def q_typed_edit_quarantine(spark, sf_dir):
    """The typed edits that were not applied, with the reason (M3)."""
    _, bad = store.apply_edits(kept(stored_calls(spark, sf_dir), "stored"), kept(_typed_edits(spark, sf_dir), "edits"))
    return bad.select("edit_id", "call_id", "field", "reason")


# ----------------------------------------------------------------- detail, lists, ingest
@register("call_detail")
def q_call_detail(spark, sf_dir):
    """The whole detail record of every call (T8): labels, four scores with reasons and anchors, the transcript's turns."""
    d = views.call_detail(stored_calls(spark, sf_dir), "+05:30")
    score = lambda c: F.array_join(F.transform("scores", lambda s: s[c].cast("string")), "|")
    turn = lambda t: F.concat_ws("~", t["stamp"], t["speaker"], t["utterance"])
    return d.select("call_id", "title", "subtitle", "overall_text", "unit_configuration", "budget_label", "timeline", "locations_label", "site_visit_outcome",
                    "last_stage_reached", "recommended_next_action", "next_action_reason", "summary", score("dimension_label").alias("dimensions"),
                    score("score").alias("scores"), score("reason").alias("reasons"), score("anchor").alias("anchors"),
                    F.size(F.filter("turns", lambda t: t["parsed"])).alias("parsed_turns"), F.md5(F.array_join(F.transform("turns", turn), "\n")).alias("turns_md5"))


@register("list_sorted_all")
def q_list_sorted_all(spark, sf_dir):
    """The first page of 50 of the list in each of the ten orders (O2 Q10)."""
    rows = kept(views.list_projection(stored_calls(spark, sf_dir)), "list")
    out = None
    for key in views.SORT_KEYS:
        for descending in (True, False):
            page = views.sort_calls(rows, key, descending).limit(50)
            c, order = F.col(views.SORT_KEYS[key]), [F.col("ts").desc(), F.col("call_id")]
            # places within the page: 50 rows
            place = F.row_number().over(Window.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), *order))
            page = page.select(F.lit(key).alias("key"), F.lit(descending).alias("descending"), place.alias("place"), "call_id")
            out = page if out is None else out.unionByName(page)
    return out


@register("list_filters")
def q_list_filters(spark, sf_dir):
    """Calls by telecaller name and by next action, each alone and together."""
    rows = kept(views.list_projection(stored_calls(spark, sf_dir)), "list")
    name = rows.agg(F.min("telecaller_name")).first()[0]
    wanted = {"telecaller": dict(telecaller=name), "action": dict(action="mark_cold"), "both": dict(telecaller=name, action="mark_cold")}
    out = None
    for label, filters in wanted.items():
        page = rows.where(views.filter_predicate(**filters)).select(F.lit(label).alias("filter"), "call_id", "telecaller_name", "recommended_next_action")
        out = page if out is None else out.unionByName(page)
    return out


@register("list_text_order")
def q_list_text_order(spark, sf_dir):
    """The newest 25 records by the text of their time (Q1), offsets mixed, beside the newest 25 by instant."""
    rows = kept(ingest.typed_time(_mixed_offsets(spark, sf_dir)), "texts")
    pages = [views.newest(rows, 25, order_by_text=by_text).select(F.lit(by_text).alias("by_text"), "call_id", "timestamp") for by_text in (True, False)]
    return pages[0].unionByName(pages[1])


def _mixed_offsets(spark, sf_dir) -> DataFrame:
    """Call records whose time is ISO text with one of three offsets."""
    c = FX.calls(spark, sf_dir)
    shift = F.element_at(F.array(F.lit(330), F.lit(0), F.lit(-480)), (F.col("conv_id") % 3 + 1).cast("int"))
    zone = F.element_at(F.array(F.lit("+05:30"), F.lit("Z"), F.lit("-08:00")), (F.col("conv_id") % 3 + 1).cast("int"))
    local = F.col("ts") + F.make_dt_interval(mins=shift)
    return c.withColumn("timestamp", F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), zone)).drop("ts")


@register("calls_jsonl")
def q_calls_jsonl(spark, sf_dir):
    """Call records written as JSONL with blank lines, cut lines, texts that are no time and mixed offsets, and read back."""
    c = _mixed_offsets(spark, sf_dir)
    time = F.when(F.col("conv_id") % 9 == 4, F.lit("yesterday")).otherwise(F.col("timestamp"))
    line = F.to_json(F.struct("call_id", "telecaller_id", "telecaller_name", "lead_id", "lead_name", "duration_sec", time.alias("timestamp"), "transcript"))
    line = F.when(F.col("conv_id") % 8 == 5, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    path = _root(spark, "jsonl")
    c.select(F.when(F.col("conv_id") % 4 == 0, F.concat(line, F.lit("\n\n"))).otherwise(line).alias("value")).write.text(path)
    records = kept(ingest.typed_time(ingest.read_jsonl(spark, path)), "records")
    ok, bad = ingest.split_required(records, ["ts" if x == "timestamp" else x for x in S.CALL_REQUIRED])
    good = ok.select("call_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.md5("transcript").alias("transcript_md5"), F.lit("ok").alias("status"))
    return good.unionByName(bad.select("call_id", F.lit(None).cast("string").alias("ts"), F.lit(None).cast("string").alias("transcript_md5"),
                                       F.when(F.col("_corrupt").isNotNull(), F.lit("malformed")).otherwise(F.lit("no time")).alias("status")))


@register("reason_truncate_long")
def q_reason_truncate_long(spark, sf_dir):
    """V7 V8 on replies whose reasons, action reason and summary are whole documents."""
    d = FX.table(spark, sf_dir, "documents").select("doc_id", "text")
    reason = lambda dim: F.struct((F.col("doc_id") % 6).alias("score"), F.col("text").alias("reason")).alias(dim)
    reply = F.to_json(F.struct(F.struct(*[reason(x) for x in S.DIMENSIONS]).alias("quality_scores"), F.col("text").alias("next_action_reason"), F.col("text").alias("summary")))
    v = analyze(d.select("doc_id", reply.alias("reply")))
    a = F.col("analysis")
    cut = {"discovery": a["quality_scores"]["discovery"]["reason"], "next_step": a["quality_scores"]["next_step"]["reason"], "action": a["next_action_reason"], "summary": a["summary"]}
    return v.select("doc_id", "parse_status", *[x for k, c in cut.items() for x in (F.length(c).alias(f"{k}_chars"), F.md5(c).alias(f"{k}_md5"))])


@register("telemetry_cost")
def q_telemetry_cost(spark, sf_dir):
    """Telemetry at a price of 0.002 a call (N8), from the latency counts and the stored documents' number."""
    n = FX.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"))
    return metrics.telemetry(latency_rounds(spark, sf_dir), n, price_per_call=0.002)


@register("rules_reasons")
def q_rules_reasons(spark, sf_dir):
    """The reasons of objection handling and next step and of the next action."""
    from .queries_infer import _rules
    r = F.col("rules")
    return _rules(spark, sf_dir).select("call_id", r["quality_scores"]["objection_handling"]["reason"].alias("objection_reason"),
                                        r["quality_scores"]["next_step"]["reason"].alias("next_step_reason"), r["next_action_reason"].alias("action_reason"))


@register("rules_gazetteer")
def q_rules_gazetteer(spark, sf_dir):
    """R4 by a join with a place table: the twenty places of the rules among all customers' and suppliers' names."""
    from ..operators import gazetteer
    names = FX.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionByName(FX.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")))
    found = gazetteer.locations(FX.calls(spark, sf_dir), names.unionByName(gazetteer.builtin_places(spark)))
    return found.select("call_id", F.array_join("preferred_locations", "|").alias("preferred_locations"))


#: Terms with one run, several, a wildcard between runs, and none of three letters.
SEARCHED = ["les_", "the license", "der%lich", "th%st", "ou"]


@register("search_indexed")
def q_search_indexed(spark, sf_dir):
    """Hits per term and source over all documents (P4), by the index of three-letter runs."""
    from ..operators import search_index
    root = _root(spark, "search")
    search_index.build(FX.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), root, ["text"])
    out = None
    for term in SEARCHED:
        hits = search_index.search(spark, root, term, ["text"]).groupBy("source").agg(F.count(F.lit(1)).alias("hits")).select(F.lit(term).alias("term"), "source", "hits")
        out = hits if out is None else out.unionByName(hits)
    return out
