import hashlib
import re

from pyspark.sql import functions as F

from callsift.functions import fmt, text

SAMPLES = ["  hello ", " x y\u001c", "\u0085tab\t", "plain", "", "\n\n", "தமிழ் 😀 ", "a​b"]


def test_pystrip_and_hash_match_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    rows = df.select("s", text.pystrip("s").alias("st"), text.transcript_hash("s").alias("h")).collect()
    for r in rows:
        assert r["st"] == r["s"].strip()
        assert r["h"] == hashlib.sha256(r["s"].strip().encode("utf-8")).hexdigest()[:32]


def test_duration_and_turns(spark):
    t = "[00:00-00:04] Agent: Hello\n[00:04-00:08] Lead: yes: sollunga\nnoise line\n[01:20-01:26] Lead: ok"
    df = spark.createDataFrame([("c1", t), ("c2", "no stamps")], "call_id string, transcript string")
    d = {r["call_id"]: r["d"] for r in df.select("call_id", text.duration_from_transcript("transcript").alias("d")).collect()}
    last = re.findall(r"\[(\d+):(\d+)-(\d+):(\d+)\]", t)[-1]
    assert d == {"c1": int(last[2]) * 60 + int(last[3]), "c2": 0}
    turns = text.explode_turns(df).filter("call_id = 'c1'").orderBy("turn_no").collect()
    assert [r["speaker"] for r in turns] == ["Agent", "Lead", None, "Lead"]
    assert turns[1]["utterance"] == "yes: sollunga"
    assert turns[2]["parsed"] is False and turns[2]["line"] == "noise line"
    assert (turns[3]["start_sec"], turns[3]["end_sec"]) == (80, 86)


def test_formatting(spark):
    df = spark.createDataFrame([(125, 5, 42.0, 42.0, ["OMR", "Velachery"]), (7, 13, 55.0, 70.5, []),
                                (60, 0, None, None, None)],
                               "d long, q int, lo double, hi double, locs array<string>")
    b = F.when(F.col("lo").isNotNull(), F.struct(F.col("lo").alias("min_lakhs"), F.col("hi").alias("max_lakhs")))
    rows = df.select(fmt.fmt_duration("d").alias("dur"), fmt.quarters_one_decimal("q").alias("one"),
                     fmt.quarters_two_decimals("q").alias("two"), fmt.budget_label(b).alias("bud"),
                     fmt.locations_label("locs").alias("loc"), fmt.score_band(F.col("q") / 4.0).alias("band")).collect()
    assert [r["dur"] for r in rows] == ["2:05", "0:07", "1:00"]
    # JavaScript toFixed: 1.25 -> "1.3", 3.25 -> "3.3", 0 -> "0.0"
    assert [r["one"] for r in rows] == ["1.3", "3.3", "0.0"]
    assert [r["two"] for r in rows] == ["1.25", "3.25", "0.00"]
    assert [r["bud"] for r in rows] == ["42 L", "55–70.5 L", "Not discussed"]
    assert [r["loc"] for r in rows] == ["OMR, Velachery", "None", "None"]
    assert [r["band"] for r in rows] == [1, 3, 0]


def test_absurd_stamps_do_not_fail(spark):
    t = "[99999999999999999999:00-99999999999999999:59] Agent: hi\n[00:00-00:04] Lead: ok"
    df = spark.createDataFrame([("c", t)], "call_id string, transcript string")
    assert df.select(text.duration_from_transcript("transcript")).collect()[0][0] == 4
    rows = text.explode_turns(df).orderBy("turn_no").collect()
    assert rows[0]["start_sec"] is None and rows[1]["end_sec"] == 4
