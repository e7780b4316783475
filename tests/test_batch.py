import json
import os
import tempfile
import uuid

from pyspark.sql import functions as F

from callsift.operators import infer, ingest, partition_store
from callsift.operators.batch import run_batch
from callsift.operators.store import apply_edits
from callsift.plans.queries import stored_calls
from callsift.session import work_dir
from callsift.sources import fixtures as FX

from conftest import SF_SMALL


def _calls(spark):
    return FX.calls(spark, SF_SMALL).join(FX.replies(spark, SF_SMALL), "conv_id").withColumnRenamed("reply", "recorded_reply")


def _run(spark, rows, root, **more):
    number, summary = run_batch(spark, rows, root, infer.ReplayResponder(), F.to_timestamp(F.lit("2026-01-02 03:04:05")), extra=["recorded_reply"], **more)
    return number, dict(tuple(r) for r in summary.collect())


def test_batch_run_twice_adds_nothing(spark):
    root = work_dir(spark, f"test-batch-{uuid.uuid4().hex[:8]}")
    c = _calls(spark)
    one, first = _run(spark, c, root)
    n1 = partition_store.calls(spark, root).count()
    assert n1 == first["ok"] and first["ok"] + first.get("fail", 0) == c.count()
    two, second = _run(spark, c, root)
    assert (one, two) == (1, 1) and partition_store.calls(spark, root).count() == n1
    assert second.get("skipped") == n1 and second.get("ok", 0) == 0
    # forced: every call is asked again, nothing is added
    three, forced = _run(spark, c, root, force=True)
    assert three == 2 and forced == first and partition_store.calls(spark, root).count() == n1


def test_repeated_ids_are_stored_once(spark):
    root = work_dir(spark, f"test-batch-{uuid.uuid4().hex[:8]}")
    c = _calls(spark)
    late = c.withColumns({"ts": F.expr("ts + interval 1 hour"), "transcript": F.concat("transcript", F.lit(" again"))})
    # the first row of every third id fails, its repeat validates
    early = c.withColumn("recorded_reply", F.when(F.col("conv_id") % 3 == 0, F.lit("no")).otherwise(F.col("recorded_reply")))
    _, got = _run(spark, early.unionByName(late), root)
    _, plain = _run(spark, c, root + "b")
    stored = partition_store.calls(spark, root)
    third = partition_store.calls(spark, root + "b").filter("cast(substring(call_id, 6) as int) % 3 = 0").count()
    assert stored.count() == stored.select("call_id").distinct().count() == got["ok"] == plain["ok"]
    assert got["fail"] == 2 * plain["fail"] + third and got["skipped"] == plain["ok"] - third
    assert stored.filter("transcript like '% again'").count() == third


def test_an_invalid_edit_hides_no_earlier_valid_one(spark):
    calls = stored_calls(spark, SF_SMALL)
    some = calls.select("call_id").first()[0]
    path = "extraction.timeline"
    edits = spark.createDataFrame([(some, path, "immediate", "2026-01-01 00:00:00", 1), (some, path, "6_to_12_months", "2026-01-01 00:00:00", 2),
                                   (some, path, "bogus", "2026-01-02 00:00:00", 3), ("nobody", path, "immediate", "2026-01-02 00:00:00", 4)],
                                  "call_id string, field string, value string, edited_at string, edit_id long")
    out, bad = apply_edits(calls, edits.withColumn("edited_at", F.to_timestamp("edited_at")))
    assert out.filter(F.col("call_id") == some).select("analysis.extraction.timeline", "edited").first() == ("6_to_12_months", True)
    assert sorted(r["edit_id"] for r in bad.collect()) == [3, 4]


def test_long_numbers_are_not_cut(spark):
    rows = spark.createDataFrame([(7,), (1234567,), (12345678,)], "n long").select(FX.padded(F.col("n"), 6)).collect()
    assert [r[0] for r in rows] == ["000007", "1234567", "12345678"]


def test_read_labels(spark):
    d = tempfile.mkdtemp(prefix="callsift-labels-")
    rows = [{"transcript": "t1", "call_id": "C1", "label": {"extraction": {"unit_configuration": "2BHK",
             "budget_range": {"min_lakhs": 40, "max_lakhs": 50}, "preferred_locations": ["OMR"]},
             "quality_scores": {"pitch": {"score": 3}}, "last_stage_reached": "pitch"}},
            {"transcript": "t2", "label": {"extraction": {"budget_range": "not_discussed"}}}]
    with open(os.path.join(d, "labels.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    got = {r["transcript"]: r for r in ingest.read_labels(spark, d).collect()}
    assert got["t1"]["label"]["extraction"]["budget_range"]["max_lakhs"] == 50.0
    assert got["t1"]["label"]["quality_scores"]["pitch"]["score"] == 3
    assert got["t1"]["label"]["quality_scores"]["discovery"] is None
    assert got["t2"]["call_id"] is None
