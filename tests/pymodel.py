"""A plain-Python statement of the reply-validation rules, used as the test oracle.

Written from the rules' description (SURVEY Q2-Q5, Q15): strip, optional fence,
first '{' to last '}', strict JSON, falsy sections, enum / score / budget /
location coercion.
"""

import json
import re

UNITS = {"2BHK", "3BHK", "4BHK", "villa", "plot", "not_discussed"}
TIMES = {"immediate", "3_to_6_months", "6_to_12_months", "exploring", "unclear"}
VISITS = {"committed_with_date", "committed_no_date", "declined", "not_asked", "call_cut"}
STAGES = {"greeting", "discovery", "pitch", "objection_handling", "close_attempt", "next_step_confirmed"}
ACTS = {"schedule_callback_3_days", "confirm_site_visit", "escalate_to_manager", "send_brochure_whatsapp",
        "mark_cold", "no_action"}
DIMS = ["discovery", "pitch", "objection_handling", "next_step"]


def enum(v, allowed, default):
    if isinstance(v, str) and v.strip() in allowed:
        return v.strip()
    return default


def score(v):
    try:
        x = int(round(float(v)))
    except Exception:  # noqa: BLE001
        return 0
    return min(5, max(0, x))


def budget(v):
    if not isinstance(v, dict):
        return None
    try:
        lo = float(v.get("min_lakhs", 0))
        hi = float(v.get("max_lakhs", lo))
    except Exception:  # noqa: BLE001
        return None
    if lo <= 0 and hi <= 0:
        return None
    return (min(lo, hi), max(lo, hi))


def text(v, n):
    return str(v or "")[:n]


def section(obj, key):
    v = obj.get(key, {}) or {}
    if not isinstance(v, dict):
        raise TypeError("section")
    return v


def validate(reply):
    t = reply.strip()
    m = re.search(r"```(?:json)?\s*(\{.*\})\s*```", t, re.DOTALL)
    if m:
        t = m.group(1)
    a, b = t.find("{"), t.rfind("}")
    if a < 0 or b < 0:
        return "no_json", None
    try:
        obj = json.loads(t[a:b + 1])
    except ValueError:
        return "bad_json", None
    try:
        ex, qs = section(obj, "extraction"), section(obj, "quality_scores")
        dims = {d: section(qs, d) for d in DIMS}
        locs = [str(x).strip() for x in (ex.get("preferred_locations") or []) if str(x).strip()]
    except TypeError:
        return "bad_shape", None
    return "ok", {
        "unit": enum(ex.get("unit_configuration"), UNITS, "not_discussed"),
        "budget": budget(ex.get("budget_range")),
        "timeline": enum(ex.get("timeline"), TIMES, "unclear"),
        "locations": locs,
        "visit": enum(ex.get("site_visit_outcome"), VISITS, "not_asked"),
        "scores": [score(dims[d].get("score", 0)) for d in DIMS],
        "reasons": [text(dims[d].get("reason"), 400) for d in DIMS],
        "stage": enum(obj.get("last_stage_reached"), STAGES, "greeting"),
        "action": enum(obj.get("recommended_next_action"), ACTS, "no_action"),
        "action_reason": text(obj.get("next_action_reason"), 400),
        "summary": text(obj.get("summary"), 600),
    }
