"""Rules analyzer: the analysis built from the transcript itself.

The reference delegates these fields to a language model; this module is an
offline definition of ours that follows the field prose (SURVEY 2.12.1).  It
runs when no responder is supplied and can be checked against SQL.

Every call's turns come from its own transcript value, so all features are
computed inside the row with array higher-order functions (``transform``,
``filter``, ``aggregate``): no shuffle, no window, no group - a call is
analysed where it is read, and a very long call costs only its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.text import TURN_RE

# ---------------------------------------------------------------------------
# The vocabularies of the rules (lower-case regexes, RE2-safe).
# ---------------------------------------------------------------------------
UNIT_RE = r"([234])\s*-?\s*bhk|\b(villa)\b|\b(plot)s?\b"
AMOUNT_RE = r"(\d+(?:\.\d+)?)(?:\s*(?:-|–|to)\s*(\d+(?:\.\d+)?))?\s*(lakhs?|l\b|crores?|cr\b)"
PUSHBACK_RE = r"too (high|much|costly)|expensive|over budget"
MONTHS_RE = r"(\d+)(?:\s*(?:to|-)\s*\d+)?\s*months?"
IMMEDIATE_RE = r"immediate|right away|this month"
EXPLORING_RE = r"exploring|just looking|later"
AGREE_RE = r"\b(yes|ok|okay|sure|fine|seri|sari|haan)\b"
REFUSE_RE = r"not interested|no need|vendaam|venaam|pannadheenga"
DEFER_RE = r"let me (discuss|think|check)|let you know|discuss with"
DATE_RE = r"\b(mon|tues|wednes|thurs|fri|satur|sun)day\b|tomorrow|\d{1,2}\s*(am|pm)"
SOFT_RE = r"weekend|next week|\d+ weeks?"
VISIT_ASK_RE = r"site visit|visit the site"
FOLLOWUP_RE = r"follow up|call (you|back)"
BROCHURE_RE = r"brochure"
LATER_RE = r"call you later"
ENDED_RE = r"call ended|disconnect"
NOT_HERE_RE = r"work (in|at)|too far|dooram"
GENERIC_RE = r"do not worry|don.t worry|good project"
GREETING_RE = r"hello|good (morning|afternoon|evening)|vanakkam"
ESCALATE_RE = r"manager|complaint|refund"
SEND_RE = r"send|details|brochure"
OBJECTION_RE = PUSHBACK_RE + r"|too far|dooram|not now|other (project|builder)|" + DEFER_RE
VAGUE_RE = r"looking for"
AREAS = [("budget", r"budget|price range"), ("timeline", r"when |timeline"),
         ("unit", r"bhk|bedroom|configuration"), ("living", r"family|staying|living|rent")]
TOPICS = [("location", r"metro|km\b|min\b|near|highway|corridor"), ("price", AMOUNT_RE),
          ("specs", r"sq\.?\s*ft|sqft|carpet"), ("amenities", r"pool|gym|clubhouse|amenit"),
          ("builder", r"builder|years|trusted"), ("emi", r"\bemi\b|loan"), ("rera", r"\brera\b")]
# Localities recognised as preferred locations (display spelling).
GAZETTEER = ["Adyar", "Anna Nagar", "Chromepet", "ECR", "Guindy", "Kelambakkam", "Medavakkam", "Mylapore",
             "Nungambakkam", "OMR", "Pallikaranai", "Perambur", "Perungudi", "Porur", "Sholinganallur",
             "Siruseri", "T Nagar", "Tambaram", "Thoraipakkam", "Velachery"]
# ---------------------------------------------------------------------------
PLACE_RE = r"\b(" + "|".join(g.lower() for g in GAZETTEER) + r")\b"


def _rx(u: Column, pat: str) -> Column:
    return u.rlike(pat)


def _turns(transcript: Column) -> Column:
    """array<struct>: one element per Agent/Lead line with its features."""
    lines = F.split(transcript, "\n", -1)
    parsed = F.filter(F.transform(lines, lambda ln, i: F.struct(
        i.alias("idx"), F.regexp_extract(ln, TURN_RE, 6).alias("spk"),
        F.lower(F.regexp_extract(ln, TURN_RE, 7)).alias("u"))), lambda t: t["spk"] != "")

    def feats(t):
        u = t["u"]
        unit_m = F.try_element_at(F.regexp_extract_all(u, F.lit(UNIT_RE), 0), F.lit(-1))
        unit = (F.when(unit_m.rlike("bhk"), F.concat(F.regexp_extract(unit_m, "([234])", 1), F.lit("BHK")))
                .when(unit_m.startswith("villa"), F.lit("villa")).when(unit_m.startswith("plot"), F.lit("plot")))
        mult = F.when(F.regexp_extract(u, AMOUNT_RE, 3).startswith("c"), F.lit(100.0)).otherwise(F.lit(1.0))
        lo = F.regexp_extract(u, AMOUNT_RE, 1)
        hi = F.regexp_extract(u, AMOUNT_RE, 2)
        has_amt = lo != ""
        months = F.regexp_extract(u, MONTHS_RE, 1)
        m = months.try_cast("int")
        tl = (F.when(m < 3, F.lit("immediate")).when(m < 6, F.lit("3_to_6_months"))
              .when(m <= 12, F.lit("6_to_12_months")).when(m > 12, F.lit("exploring")))
        kw = F.when(_rx(u, IMMEDIATE_RE), F.lit("immediate")).when(_rx(u, EXPLORING_RE), F.lit("exploring"))
        q = u.contains("?")
        return F.struct(
            t["idx"].alias("idx"), t["spk"].alias("spk"), u.alias("u"), unit.alias("unit"),
            F.when(has_amt, lo.cast("double") * mult).alias("lo"),
            F.when(has_amt, F.when(hi != "", hi.cast("double")).otherwise(lo.cast("double")) * mult).alias("hi"),
            F.when(months != "", tl).alias("tl_months"), kw.alias("tl_kw"),
            F.transform(F.regexp_extract_all(u, F.lit(PLACE_RE), 1), lambda p: p).alias("places"),
            q.alias("q"),
            F.filter(F.array(*[F.when(q & _rx(u, p), F.lit(n)) for n, p in AREAS]), lambda a: a.isNotNull()).alias("areas"),
            F.filter(F.array(*[F.when(_rx(u, p), F.lit(n)) for n, p in TOPICS]), lambda a: a.isNotNull()).alias("topics"),
            _rx(u, OBJECTION_RE).alias("objection"), _rx(u, PUSHBACK_RE).alias("pushback"),
            _rx(u, AGREE_RE).alias("agree"), _rx(u, REFUSE_RE).alias("refuse"), _rx(u, DEFER_RE).alias("defer"),
            _rx(u, DATE_RE).alias("date"), _rx(u, SOFT_RE).alias("soft"), _rx(u, VISIT_ASK_RE).alias("ask_visit"),
            _rx(u, FOLLOWUP_RE).alias("ask_fu"), _rx(u, BROCHURE_RE).alias("ask_br"), _rx(u, LATER_RE).alias("later"),
            _rx(u, ENDED_RE).alias("ended"), _rx(u, NOT_HERE_RE).alias("not_here"), _rx(u, GENERIC_RE).alias("generic"),
            _rx(u, GREETING_RE).alias("greet"), _rx(u, ESCALATE_RE).alias("escalate"), _rx(u, SEND_RE).alias("send"),
            _rx(u, VAGUE_RE).alias("vague"), _rx(u, r"\d").alias("digit"))
    return F.transform(parsed, feats)


def _last(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def _first(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def _next_of(turns: Column, t: Column, spk: str) -> Column:
    """The first turn of speaker ``spk`` after turn ``t``."""
    return _first(F.filter(turns, lambda y: (y["idx"] > t["idx"]) & (y["spk"] == spk)))


def next_action(flags: Column, visit: Column, stage: Column) -> Column:
    """The first matching action, from the lead's intents in the transcript (``flags``:
    refuse, escalate, agreed_visit, send, defer) and the call's visit outcome and stage."""
    return (F.when(flags["refuse"], F.lit("mark_cold"))
            .when(flags["escalate"], F.lit("escalate_to_manager"))
            .when((visit == "committed_with_date") | flags["agreed_visit"], F.lit("confirm_site_visit"))
            .when(flags["send"], F.lit("send_brochure_whatsapp"))
            .when(flags["defer"], F.lit("schedule_callback_3_days"))
            .when(stage == "greeting", F.lit("mark_cold")).otherwise(F.lit("no_action")))


def intent_flags(calls: DataFrame, transcript: str = "transcript") -> DataFrame:
    """Add ``flags`` (the lead intents R8 reads) computed in-row from the transcript."""
    d = calls.withColumn("_T", _turns(F.col(transcript)))
    T = F.col("_T")
    lead = F.filter(T, lambda t: t["spk"] == "Lead")
    visit_asks = F.filter(T, lambda t: (t["spk"] == "Agent") & t["ask_visit"])
    reply = _next_of(T, _last(visit_asks), "Lead")
    flags = F.struct(F.exists(lead, lambda t: t["refuse"]).alias("refuse"),
                     F.exists(lead, lambda t: t["escalate"]).alias("escalate"),
                     ((F.size(visit_asks) > 0) & F.coalesce(reply["agree"], F.lit(False))).alias("agreed_visit"),
                     F.exists(lead, lambda t: t["send"]).alias("send"), F.exists(lead, lambda t: t["defer"]).alias("defer"))
    return d.withColumn("flags", flags).drop("_T")


def rules_analysis(calls: DataFrame, transcript: str = "transcript") -> DataFrame:
    """Add ``rules`` (schema.ANALYSIS shape) computed from the transcript text."""
    d = calls.withColumn("_T", _turns(F.col(transcript)))
    T = F.col("_T")
    lead = F.filter(T, lambda t: t["spk"] == "Lead")
    agent = F.filter(T, lambda t: t["spk"] == "Agent")
    # asks and the lead's reply to the last ask
    asks = F.filter(agent, lambda t: t["ask_visit"] | t["ask_fu"] | t["ask_br"])
    visit_asks = F.filter(agent, lambda t: t["ask_visit"])
    d = d.withColumns({
        "_lead": lead, "_agent": agent, "_asks": asks,
        "_visit_reply": _next_of(T, _last(visit_asks), "Lead"), "_visit_asked": F.size(visit_asks) > 0,
        "_ask_reply": _next_of(T, _last(asks), "Lead"),
        # objections with the class of the next agent turn
        "_obj": F.transform(F.filter(lead, lambda t: t["objection"]), lambda t: _next_of(T, t, "Agent")),
        "_agent_after_obj": F.transform(F.filter(lead, lambda t: t["objection"]),
                                        lambda t: _next_of(T, t, "Agent")["idx"]),
    })
    L, A = F.col("_lead"), F.col("_agent")
    # R1 unit
    lead_unit = _last(F.filter(L, lambda t: t["unit"].isNotNull()))["unit"]
    agent_unit = _last(F.filter(A, lambda t: t["unit"].isNotNull()))["unit"]
    unit = F.coalesce(lead_unit, agent_unit, F.lit(S.DEFAULT_UNIT))
    # R2 budget: last lead amount, else last agent amount whose next lead turn has no pushback
    lead_amt = _last(F.filter(L, lambda t: t["lo"].isNotNull()))
    agent_amt = _last(F.filter(A, lambda t: t["lo"].isNotNull() & F.coalesce(~_next_of(T, t, "Lead")["pushback"], F.lit(False))))
    amt = F.coalesce(lead_amt, agent_amt)
    budget = F.when(amt.isNotNull() & ((amt["lo"] > 0) | (amt["hi"] > 0)),
                    F.struct(F.least(amt["lo"], amt["hi"]).alias("min_lakhs"), F.greatest(amt["lo"], amt["hi"]).alias("max_lakhs")))
    # R3 timeline: month counts beat keywords; last lead hit wins
    timeline = F.coalesce(_last(F.filter(L, lambda t: t["tl_months"].isNotNull()))["tl_months"],
                          _last(F.filter(L, lambda t: t["tl_kw"].isNotNull()))["tl_kw"], F.lit(S.DEFAULT_TIMELINE))
    # R4 locations
    lead_places = F.flatten(F.transform(F.filter(L, lambda t: ~t["not_here"]), lambda t: t["places"]))
    agreed_places = F.flatten(F.transform(
        F.filter(A, lambda t: t["q"] & F.coalesce(_next_of(T, t, "Lead")["agree"] & ~_next_of(T, t, "Lead")["not_here"], F.lit(False))),
        lambda t: t["places"]))
    canon = F.create_map(*[x for g in GAZETTEER for x in (F.lit(g.lower()), F.lit(g))])
    locations = F.array_sort(F.array_distinct(F.transform(F.concat(lead_places, agreed_places), lambda p: canon[p])))
    # R5 site visit
    vr = F.col("_visit_reply")
    any_refuse = F.exists(L, lambda t: t["refuse"])
    visit = (F.when(F.col("_visit_asked"),
                    F.when(vr.isNull(), F.lit("call_cut")).when(vr["refuse"], F.lit("declined"))
                    .when(vr["agree"] & vr["date"], F.lit("committed_with_date"))
                    .when(vr["agree"] | vr["defer"], F.lit("committed_no_date")).otherwise(F.lit("not_asked")))
             .when(any_refuse, F.lit("declined"))
             .when(F.exists(T, lambda t: t["ended"]), F.lit("call_cut")).otherwise(F.lit("not_asked")))
    d = d.withColumns({"_unit": unit, "_budget": budget, "_timeline": timeline, "_locs": locations, "_visit": visit})
    # R6a discovery
    area_turns = F.transform(F.filter(A, lambda t: t["q"]), lambda t: t["areas"])
    all_areas = F.flatten(area_turns)
    n_areas = F.size(F.array_distinct(all_areas))
    follow = F.size(all_areas) > n_areas
    brief = F.exists(area_turns, lambda a: F.size(a) == 4) & (F.size(F.filter(area_turns, lambda a: F.size(a) > 0)) == 1)
    vague = F.exists(A, lambda t: t["q"] & t["vague"] & (F.size(t["areas"]) == 0))
    discovery = (F.when(n_areas == 4, F.when(follow, F.lit(5)).when(brief, F.lit(3)).otherwise(F.lit(4)))
                 .when(n_areas == 3, F.lit(4)).when(n_areas == 2, F.lit(3)).when(n_areas == 1, F.lit(2))
                 .when(vague, F.lit(1)).otherwise(F.lit(0)))
    hit_areas = F.array_sort(F.array_distinct(all_areas))
    missed_areas = F.array_except(F.array(*[F.lit(n) for n, _ in AREAS]), hit_areas)
    # R6b pitch
    topics = F.array_sort(F.array_distinct(F.flatten(F.transform(A, lambda t: t["topics"]))))
    pitch = F.least(F.lit(5), F.size(topics))
    missed_topics = F.array_except(F.array(*[F.lit(n) for n, _ in TOPICS]), topics)
    # R6c objection handling: class of the next agent turn per objection
    cls = F.transform(F.col("_obj"), lambda r: F.when(r.isNull(), F.lit("ignored"))
                      .when((F.size(r["topics"]) > 0) & r["digit"], F.lit("concrete"))
                      .when(F.size(r["topics"]) > 0, F.lit("partial"))
                      .when(r["generic"], F.lit("generic")).otherwise(F.lit("ignored")))
    n_obj = F.size(cls)
    n_conc = F.size(F.filter(cls, lambda c: c == "concrete"))
    n_part = F.size(F.filter(cls, lambda c: c == "partial"))
    n_gen = F.size(F.filter(cls, lambda c: c == "generic"))
    objection = (F.when(n_obj == 0, F.lit(3)).when(n_conc == n_obj, F.lit(5))
                 .when((n_conc == n_obj - 1) & (n_conc > 0), F.lit(4)).when(n_conc + n_part > 0, F.lit(3))
                 .when(n_gen > 0, F.lit(2)).otherwise(F.lit(1)))
    # R6d next step
    asks_c = F.col("_asks")
    ar = F.col("_ask_reply")
    only_brochure = F.forall(asks_c, lambda t: t["ask_br"] & ~t["ask_visit"] & ~t["ask_fu"])
    only_later = F.forall(asks_c, lambda t: t["later"] & ~t["ask_visit"] & ~t["ask_br"])
    next_step = (F.when(F.size(asks_c) == 0, F.lit(0))
                 .when(ar.isNotNull() & ar["agree"] & ar["date"], F.lit(5))
                 .when(ar.isNotNull() & ar["agree"], F.lit(4))
                 .when(ar.isNotNull() & ar["defer"], F.lit(3))
                 .when(only_brochure, F.lit(2)).when(only_later, F.lit(1))
                 .when(ar.isNotNull(), F.lit(3)).otherwise(F.lit(1)))
    d = d.withColumns({"_disc": discovery, "_pitch": pitch, "_objh": objection, "_next": next_step,
                       "_hit_areas": hit_areas, "_missed_areas": missed_areas, "_topics": topics,
                       "_missed_topics": missed_topics, "_cls": cls})
    # R7 stage: rank per turn, the latest classed turn wins; a greeting after rank >= 2 is ignored
    after_obj = F.col("_agent_after_obj")
    ask_reply_idx = F.transform(asks_c, lambda t: _next_of(T, t, "Lead")["idx"])

    def rank(t):
        is_agent = t["spk"] == "Agent"
        return F.greatest(
            F.when(t["greet"], F.lit(1)).otherwise(F.lit(0)),
            F.when(is_agent & t["q"] & ((F.size(t["areas"]) > 0) | t["vague"]), F.lit(2)).otherwise(F.lit(0)),
            F.when(is_agent & (F.size(t["topics"]) > 0), F.lit(3)).otherwise(F.lit(0)),
            F.when(is_agent & F.array_contains(after_obj, t["idx"]), F.lit(4)).otherwise(F.lit(0)),
            F.when(is_agent & (t["ask_visit"] | t["ask_fu"] | t["ask_br"]), F.lit(5)).otherwise(F.lit(0)),
            F.when((t["spk"] == "Lead") & t["agree"] & F.array_contains(ask_reply_idx, t["idx"]), F.lit(6)).otherwise(F.lit(0)))
    ranks = F.transform(T, rank)
    # walk the turns: keep the latest non-zero rank, skipping greetings once rank >= 2 was seen
    walked = F.aggregate(ranks, F.struct(F.lit(0).alias("cur"), F.lit(0).alias("best")),
                         lambda acc, r: F.struct(
                             F.when((r == 0) | ((r == 1) & (acc["best"] >= 2)), acc["cur"]).otherwise(r).alias("cur"),
                             F.greatest(acc["best"], r).alias("best")))
    stages = F.array(*[F.lit(s) for s in S.LAST_STAGES])
    stage = F.when(walked["cur"] > 0, F.element_at(stages, walked["cur"])).otherwise(F.lit(S.DEFAULT_STAGE))
    # R8 action
    flags = F.struct(any_refuse.alias("refuse"), F.exists(L, lambda t: t["escalate"]).alias("escalate"),
                     (F.col("_visit_asked") & F.coalesce(F.col("_visit_reply")["agree"], F.lit(False))).alias("agreed_visit"),
                     F.exists(L, lambda t: t["send"]).alias("send"), F.exists(L, lambda t: t["defer"]).alias("defer"))
    action = next_action(flags, F.col("_visit"), stage)
    d = d.withColumns({"_stage": stage, "_action": action})
    # R9 texts
    from ..functions.fmt import budget_label
    disc_reason = F.concat(F.lit("asked about "), F.array_join(F.col("_hit_areas"), ", "), F.lit("; skipped "),
                           F.array_join(F.col("_missed_areas"), ", "))
    pitch_reason = F.concat(F.lit("covered "), F.array_join(F.col("_topics"), ", "), F.lit("; missing "),
                            F.array_join(F.col("_missed_topics"), ", "))
    obj_reason = F.concat(F.lit("objection replies: "), F.array_join(F.col("_cls"), ", "))
    next_reason = F.concat(F.lit("next-step asks: "), F.size(asks_c).cast("string"), F.lit("; site visit "),
                           F.col("_visit"))
    summary = F.concat(F.lit("Lead discussed "), F.col("_unit"), F.lit(", "), budget_label(F.col("_budget")),
                       F.lit(". Outcome: "), F.col("_visit"), F.lit(", stage "), F.col("_stage"), F.lit("."))
    action_reason = F.concat(F.lit("site visit "), F.col("_visit"), F.lit(" at stage "), F.col("_stage"))
    rules = F.struct(
        F.struct(F.col("_unit").alias("unit_configuration"), F.col("_budget").alias("budget_range"),
                 F.col("_timeline").alias("timeline"), F.col("_locs").alias("preferred_locations"),
                 F.col("_visit").alias("site_visit_outcome")).alias("extraction"),
        F.struct(*[F.struct(F.col(c).alias("score"), r.alias("reason")).alias(dim) for dim, c, r in
                   [("discovery", "_disc", disc_reason), ("pitch", "_pitch", pitch_reason),
                    ("objection_handling", "_objh", obj_reason), ("next_step", "_next", next_reason)]]).alias("quality_scores"),
        F.col("_stage").alias("last_stage_reached"), F.col("_action").alias("recommended_next_action"),
        action_reason.alias("next_action_reason"), summary.alias("summary"))
    out = d.withColumn("rules", rules)
    return out.drop(*[c for c in out.columns if c.startswith("_")])
