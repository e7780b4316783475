import json

from pymodel import DIMS, validate

from callsift.functions.coerce import validate_replies

BASE = {"extraction": {"unit_configuration": "2BHK", "budget_range": {"min_lakhs": 40, "max_lakhs": 50},
                       "timeline": "immediate", "preferred_locations": ["OMR"], "site_visit_outcome": "declined"},
        "quality_scores": {d: {"score": 3, "reason": "r"} for d in DIMS},
        "last_stage_reached": "pitch", "recommended_next_action": "mark_cold",
        "next_action_reason": "why", "summary": "Two. Sentences."}


def variant(path, value):
    obj = json.loads(json.dumps(BASE))
    cur = obj
    for k in path[:-1]:
        cur = cur[k]
    if value is KeyError:
        del cur[path[-1]]
    else:
        cur[path[-1]] = value
    return json.dumps(obj)


CASES = [
    json.dumps(BASE), "```json\n" + json.dumps(BASE) + "\n```", "Sure: " + json.dumps(BASE) + " thanks",
    "no braces here", json.dumps(BASE) + " " + json.dumps(BASE), json.dumps(BASE)[:-9], "{}", "} {",
    "  " + json.dumps(BASE) + "\x1c\x85",
    '{"extraction": [1], "quality_scores": {}}', '{"extraction": "x"}', '{"extraction": 0, "quality_scores": []}',
    '{"quality_scores": {"pitch": [1]}}', '{"quality_scores": {"pitch": 0}}',
]
for v in [" 3BHK ", "3bhk", 4, None, "villa", "plot ", True]:
    CASES.append(variant(["extraction", "unit_configuration"], v))
for v in ["not_discussed", None, {"min_lakhs": 70, "max_lakhs": 55}, {"min_lakhs": "42"}, {"min_lakhs": None, "max_lakhs": 60},
          {"max_lakhs": 60}, {"min_lakhs": 0, "max_lakhs": 0}, {"min_lakhs": -5, "max_lakhs": 30.5}, [40, 50],
          {"min_lakhs": True}, {"min_lakhs": " 12.5 ", "max_lakhs": "abc"}, {"min_lakhs": "4d"}, {}, "cheap"]:
    CASES.append(variant(["extraction", "budget_range"], v))
for v in [["OMR", " Velachery ", ""], None, [], ["Guindy", None, 12, True], "OMR", ["omr", "OMR"], 0, 5, True,
          False, "", " a b ", [1.5, -2]]:
    CASES.append(variant(["extraction", "preferred_locations"], v))
for v in [-1, 2.5, 3.5, 9, "4.5", "4/5", True, False, None, KeyError, "1e400", 1e20, "  2 ", "nan", "inf", ".5",
          "4.", [], {}, "4d", 0.49999999999999994, -0.5]:
    CASES.append(variant(["quality_scores", "pitch", "score"], v))
CASES.append(json.dumps(BASE).replace('"score": 3, "reason": "r"', '"score": 1e400, "reason": "r"', 1))
for v in [None, "x" * 450, 0, 5, True, "", "தமிழ்😀" * 100]:
    CASES.append(variant(["quality_scores", "discovery", "reason"], v))
for v in ["y" * 700, None, 12, False]:
    CASES.append(variant(["summary"], v))
for v in [" close_attempt", "Pitch", 3, None]:
    CASES.append(variant(["last_stage_reached"], v))


def spark_rows(spark, replies):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "id int, reply string")
    return {r["id"]: r for r in validate_replies(df).collect()}


def as_model(a):
    ex, qs = a["extraction"], a["quality_scores"]
    b = ex["budget_range"]
    return {"unit": ex["unit_configuration"], "budget": None if b is None else (b["min_lakhs"], b["max_lakhs"]),
            "timeline": ex["timeline"], "locations": list(ex["preferred_locations"]),
            "visit": ex["site_visit_outcome"], "scores": [qs[d]["score"] for d in DIMS],
            "reasons": [qs[d]["reason"] for d in DIMS], "stage": a["last_stage_reached"],
            "action": a["recommended_next_action"], "action_reason": a["next_action_reason"], "summary": a["summary"]}


def test_validation_matches_python_model(spark):
    got = spark_rows(spark, CASES)
    for i, reply in enumerate(CASES):
        status, want = validate(reply)
        row = got[i]
        assert row["parse_status"] == status, (reply, row["parse_status"], status)
        if status == "ok":
            assert as_model(row["analysis"]) == want, reply
        else:
            assert row["analysis"] is None


GOLDEN = """{
  "extraction": {"unit_configuration": "2BHK", "budget_range": {"min_lakhs": 42, "max_lakhs": 42},
    "timeline": "6_to_12_months", "preferred_locations": [], "site_visit_outcome": "not_asked"},
  "quality_scores": {
    "discovery": {"score": 2, "reason": "Asked about budget fit; never probed family size."},
    "pitch": {"score": 3, "reason": "Covered price, sqft, EMI estimate, and metro connectivity."},
    "objection_handling": {"score": 4, "reason": "Addressed the distance concern with commute time."},
    "next_step": {"score": 3, "reason": "Secured WhatsApp brochure share and 2-week callback."}},
  "last_stage_reached": "close_attempt",
  "recommended_next_action": "send_brochure_whatsapp",
  "summary": "Lead exploring 2BHK. Accepted brochure on WhatsApp."
}"""


def test_golden_example(spark):
    from callsift.operators.analysis import analyze
    df = spark.createDataFrame([(GOLDEN,)], "reply string")
    r = analyze(df).collect()[0]
    a = r["analysis"]
    assert r["parse_status"] == "ok"
    assert a["extraction"]["unit_configuration"] == "2BHK"
    assert (a["extraction"]["budget_range"]["min_lakhs"], a["extraction"]["budget_range"]["max_lakhs"]) == (42.0, 42.0)
    assert a["extraction"]["timeline"] == "6_to_12_months"
    assert a["extraction"]["preferred_locations"] == []
    assert a["extraction"]["site_visit_outcome"] == "not_asked"
    assert [a["quality_scores"][d]["score"] for d in DIMS] == [2, 3, 4, 3]
    assert a["last_stage_reached"] == "close_attempt"
    assert a["recommended_next_action"] == "send_brochure_whatsapp"
    assert a["next_action_reason"] == ""
    assert r["overall_score"] == 3.0 and r["score_quarters"] == 12


def test_a_long_reply_is_trimmed_matched_and_parsed_once(spark):
    """The texts that a reply goes through are columns of their own: no expression over the whole reply stands in the plan twice."""
    long = "a {b} `c` ``` d\n" * 4000
    body = json.dumps(BASE | {"summary": long, "next_action_reason": " " + long})
    replies = [body, " " + body, body + "　", "Sure: " + body + " thanks", "```json\n" + body + "\n```", body + body, body + " {", "} " + body, "", " ", "{", "}", "```{}", long]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)] + [(len(replies), None)], "id int, reply string")
    out = validate_replies(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(x) for x in ("parseJson", "regexp_extract(", "reverse(")] == [1, 1, 1]
    got = {r["id"]: r for r in out.collect()}
    assert got[len(replies)]["parse_status"] == "no_reply"
    for i, reply in enumerate(replies):
        status, want = validate(reply)
        assert got[i]["parse_status"] == status, i
        assert (as_model(got[i]["analysis"]) if status == "ok" else got[i]["analysis"]) == (want if status == "ok" else None), i
