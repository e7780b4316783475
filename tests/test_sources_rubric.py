import datetime
import json
import os
import tempfile

from pyspark.sql import functions as F

from callsift.operators import ingest, metrics, rubric
from callsift.sources import fixtures as FX


def test_jsonl_blank_and_bad_lines_are_quarantined(spark):
    d = tempfile.mkdtemp(prefix="callsift-test-")
    good = {"call_id": "C1", "telecaller_id": "T", "telecaller_name": "n", "lead_id": "L", "lead_name": "l",
            "duration_sec": 30, "timestamp": "2026-04-10T14:32:00+05:30", "transcript": "[00:00-00:04] Agent: hi"}
    missing = dict(good, call_id="C2")
    del missing["lead_name"]
    with open(os.path.join(d, "calls.jsonl"), "w") as f:
        f.write(json.dumps(good) + "\n\n   \n" + "{not json\n" + json.dumps(missing) + "\n")
    df = ingest.read_jsonl(spark, d)
    ok, bad = ingest.split_required(df)
    assert [r["call_id"] for r in ok.collect()] == ["C1"]
    assert bad.count() == 2


def test_rubric_block_and_json(spark):
    block = rubric.rubric_prompt_block()
    assert block.startswith("## discovery\n")
    assert "\n  5: " in block and "  NOTE: If the lead raised no objections" in block
    spark_block = rubric.rubric_prompt_block_df(rubric.rubric_table(spark)).collect()[0]["block"]
    assert spark_block == block
    j = json.loads(rubric.rubric_json())
    assert list(j) == ["discovery", "pitch", "objection_handling", "next_step"]
    assert j["pitch"]["note"] == "" and sorted(j["pitch"]["anchors"]) == ["0", "1", "2", "3", "4", "5"]
    assert rubric.SYSTEM_PROMPT.count("## ") == 4


def test_labels_budget_and_pairing(spark):
    d = tempfile.mkdtemp(prefix="callsift-test-")
    budgets = [{}, {"budget_range": "not_discussed"}, {"budget_range": {"min_lakhs": 40, "max_lakhs": 50}},
               {"budget_range": None}, {"budget_range": "soon"}]
    with open(os.path.join(d, "labels.jsonl"), "w") as f:
        for i, b in enumerate(budgets):
            row = {"transcript": f"t{i}", "label": {"extraction": b, "last_stage_reached": "pitch"}}
            f.write(json.dumps(row if i % 2 else dict(row, call_id=f"C{i}")) + "\n")
        f.write(json.dumps({"transcript": "unseen", "label": {}}) + "\n")
    labels, bad = ingest.split_required(ingest.read_labels(spark, d), ["transcript", "label"])
    assert bad.count() == 0
    got = {r["transcript"]: (r["budget_given"], r["label"]["extraction"] and r["label"]["extraction"]["budget_range"]) for r in labels.collect()}
    assert [got[f"t{i}"][0] for i in range(5)] == [False, True, True, False, False]
    assert tuple(got["t2"][1]) == (40.0, 50.0) and got["t1"][1] is None
    preds = spark.createDataFrame(
        [(f"C{i}", f"t{i}", (("2BHK", None, "unclear", [], "declined"), None, "pitch", "mark_cold", "", ""), "ok") for i in range(5)],
        "call_id string, transcript string, pred struct<extraction:struct<unit_configuration:string,budget_range:struct<min_lakhs:double,"
        "max_lakhs:double>,timeline:string,preferred_locations:array<string>,site_visit_outcome:string>,quality_scores:string,"
        "last_stage_reached:string,recommended_next_action:string,next_action_reason:string,summary:string>, parse_status string")
    preds = preds.withColumn("transcript_hash", ingest.transcript_hash("transcript")).drop("transcript")
    pairs = metrics.pair_labels(preds, labels).cache()
    assert [r["parse_status"] for r in pairs.filter("parse_status <> 'ok'").collect()] == ["no_prediction"]
    acc = {r["field"]: (r["correct"], r["total"]) for r in metrics.field_accuracy(pairs.filter("parse_status = 'ok'")).collect()}
    assert acc["budget_range"] == (1, 5) and acc["last_stage_reached"] == (5, 5)


def test_jsonl_times_are_instants(spark):
    df = spark.createDataFrame([("a", "2026-04-10T00:32:00+05:30"), ("b", "2026-04-10T00:32:00Z"), ("c", "soon")], "call_id string, timestamp string")
    got = {r["call_id"]: r["t"] for r in ingest.typed_time(df).selectExpr("call_id", "unix_seconds(ts) t").collect()}
    base = int(datetime.datetime(2026, 4, 9, 19, 2, tzinfo=datetime.timezone.utc).timestamp())
    assert got == {"a": base, "b": base + 19800, "c": None}


def test_percentiles_follow_the_rank_rule(spark):
    values = [float(i * i % 97) for i in range(1000)] + [1e9, -5.0, 0.0, -0.0] + [7.0] * 500
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    got = {r["q"]: r["value"] for r in metrics.rank_rule_percentiles(df, "v", [0.0, 0.5, 0.9, 0.99, 1.0]).collect()}
    ranked = sorted(values)
    assert got == {q: ranked[min(int(q * len(ranked)), len(ranked) - 1)] for q in got} and len(got) == 5
    assert metrics.rank_rule_percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_replies_are_made_in_as_many_tasks_as_a_shuffle_has(spark, tmp_path):
    """Ids of conversations take a few bytes: joined into one partition, one task would validate all replies."""
    spark.range(4000).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("a").alias("text")).write.parquet(f"{tmp_path}/conversations.parquet")
    replies = FX.replies(spark, str(tmp_path))
    assert replies.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert replies.count() == 4000
