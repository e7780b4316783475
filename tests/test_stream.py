import uuid

from pyspark.sql import functions as F

from callsift.operators import infer, partition_store
from callsift.session import work_dir
from callsift.sources import fixtures as FX
from callsift.streaming.upload import process_uploads, run_upload_stream

from conftest import SF_SMALL

TS = "2026-01-02 03:04:05"


def _payloads(spark):
    c = FX.calls(spark, SF_SMALL).join(FX.replies(spark, SF_SMALL), "conv_id")
    pay = c.select("conv_id", F.col("call_id").alias("doc_key"), "transcript", "telecaller_name", "lead_name",
                   F.col("reply").alias("recorded_reply"))
    again = pay.filter(F.col("conv_id") % 5 == 0).withColumn("doc_key", F.concat("doc_key", F.lit("#2")))
    return pay.drop("conv_id"), again.drop("conv_id")


def _rows(df):
    return sorted((tuple(r) for r in df.select("doc_key", "call_id", "cached", "overall_score", "status").collect()), key=str)


def test_stream_replay_adds_nothing_and_equals_batch(spark):
    base = work_dir(spark, f"test-stream-{uuid.uuid4().hex[:8]}")
    first, again = _payloads(spark)
    first.repartition(2).write.json(f"{base}/in")
    again.repartition(2).write.mode("append").json(f"{base}/in")
    args = dict(responder=infer.ReplayResponder(), checkpoint=f"{base}/ckpt", ingest_ts=F.to_timestamp(F.lit(TS)),
                files_per_trigger=2, extra_schema="doc_key string, recorded_reply string", wait_sec=0.0)
    run_upload_stream(spark, f"{base}/in", f"{base}/store", f"{base}/out", **args)
    out1 = _rows(spark.read.parquet(f"{base}/out/responses"))
    one = partition_store.version(spark, f"{base}/store").number
    n_store = partition_store.calls(spark, f"{base}/store").count()
    # a second run over the same files and checkpoint processes nothing new
    run_upload_stream(spark, f"{base}/in", f"{base}/store", f"{base}/out", **args)
    assert _rows(spark.read.parquet(f"{base}/out/responses")) == out1
    assert partition_store.version(spark, f"{base}/store").number == one
    # every payload is answered; one distinct stored call per validated transcript
    assert len(out1) == first.count() + again.count()
    assert n_store == len({r[1] for r in out1 if r[4] == "ok"}) and all(r[2] for r in out1 if r[0].endswith("#2") and r[4] == "ok")
    assert all(r[1] is None and not r[2] for r in out1 if r[4] != "ok")
    # the same payloads as one batch give the same answers
    process_uploads(spark, first.unionByName(again), f"{base}/bstore", infer.ReplayResponder(), 0,
                    F.to_timestamp(F.lit(TS)), f"{base}/bout", wait_sec=0.0)
    assert _rows(spark.read.parquet(f"{base}/bout/responses")) == out1


def test_replayed_epoch_changes_nothing(spark):
    base = work_dir(spark, f"test-stream-{uuid.uuid4().hex[:8]}")
    first, again = _payloads(spark)
    blank = first.limit(1).withColumns({"doc_key": F.lit("blank"), "transcript": F.lit(" ")})
    args = (infer.ReplayResponder(),)

    def run(df, epoch):
        process_uploads(spark, df, f"{base}/store", *args, epoch, F.to_timestamp(F.lit(TS)), f"{base}/out", wait_sec=0.0)
        store = sorted(tuple(r) for r in partition_store.calls(spark, f"{base}/store").select("call_id", "overall_score").collect())
        return partition_store.version(spark, f"{base}/store").number, store, _rows(spark.read.parquet(f"{base}/out/responses")), spark.read.parquet(f"{base}/out/attempts").count()

    one = run(first.unionByName(blank), 0)
    assert run(first.unionByName(blank), 0) == one
    assert [r[4] for r in one[2] if r[0] == "blank"] == ["rejected"]
    two = run(again, 1)
    assert run(again, 1) == two and two[1] == one[1]


def test_plain_payload_is_answered(spark):
    base = work_dir(spark, f"test-stream-{uuid.uuid4().hex[:8]}")
    pay = spark.createDataFrame([("same words", None, None), (None, "same words", "x"), (" ", None, None)],
                                "transcript string, text string, lead_name string")
    process_uploads(spark, pay.coalesce(1), f"{base}/store", infer.ReplayResponder(), 0, F.to_timestamp(F.lit(TS)), f"{base}/out", wait_sec=0.0)
    rows = _rows(spark.read.parquet(f"{base}/out/responses"))
    assert len(rows) == 3 and len({r[0] for r in rows}) == 3 and [r[4] for r in rows].count("rejected") == 1
