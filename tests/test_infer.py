"""Model runs: waves that a broken run does not repeat, a rate for the whole job, latency counts."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from callsift.operators import infer, metrics
from callsift.session import work_dir

GOOD = '{"quality_scores": {"pitch": {"score": 4}}}'


def recorder(folder, dies_at=None):
    """Notes every transcript that it is asked; takes its worker down at one of them."""
    def factory():
        def respond(batch):
            h = batch["transcript_hash"].iloc[0]
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(h)
            if h == dies_at:
                os._exit(1)
            return ["no" if h.endswith("7") and batch["_attempt"].iloc[0] == 1 else GOOD]
        return respond
    return factory


def asked(folder):
    out = []
    for n in os.listdir(folder):
        with open(os.path.join(folder, n)) as f:
            out.append(f.read())
    return sorted(out)


def test_a_broken_run_repeats_one_wave(spark, tmp_path):
    df = spark.createDataFrame([(f"h{i:03d}", f"t{i}") for i in range(40)], "transcript_hash string, transcript string")
    wave = {r.transcript_hash: r.w for r in df.select("transcript_hash", infer._wave(4).alias("w")).collect()}
    victim = sorted(h for h, w in wave.items() if w == 2)[0]
    one, two = tmp_path / "one", tmp_path / "two"
    one.mkdir()
    two.mkdir()
    log = work_dir(spark, f"test-waves-{uuid.uuid4().hex[:8]}")
    args = dict(wait_sec=0.0, log_dir=log, wave=10, partitions=2)
    with pytest.raises(Exception):
        infer.infer_with_retries(spark, df, recorder(str(one), victim), **args)
    assert {wave[h] for h in asked(one)} == {0, 1, 2}
    infer.infer_with_retries(spark, df, recorder(str(two)), **args)
    again = asked(two)
    first = [h for h in again if not h.endswith("7")]
    # the waves that were whole are not asked again; of the first round only waves 2 and 3
    assert {wave[h] for h in first} == {2, 3} and len(first) == len(set(first))
    assert all(again.count(h) == (2 if wave[h] > 1 else 1) for h in wave if h.endswith("7"))
    res = infer.final_results(spark, log).collect()
    assert len(res) == 40 and all(r.parse_status == "ok" and r.attempts == (2 if r.transcript_hash.endswith("7") else 1) for r in res)
    # a third run asks nothing
    three = tmp_path / "three"
    three.mkdir()
    infer.infer_with_retries(spark, df, recorder(str(three)), **args)
    assert asked(three) == []


def test_latency_counts_replace_the_attempts(spark, tmp_path):
    df = spark.createDataFrame([(f"h{i}", "t") for i in range(10)], "transcript_hash string, transcript string")
    log = infer.infer_with_retries(spark, df, recorder(str(tmp_path)), wait_sec=0.0)
    counts = infer.logged_latencies(spark, log)
    assert all("_latencies" in f for f in counts.inputFiles())
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, metrics.latency_counts(infer.attempt_log_metrics(spark, log)).collect()))
    n = spark.createDataFrame([(5,)], "n long")
    t = metrics.telemetry(counts.unionByName(counts), n, price_per_call=0.5).first()
    assert (t.llm_calls, t.errors, t.total_calls_in_db, t.estimated_cost_usd) == (22, 2, 5, 11.0)


@pytest.mark.parametrize("tasks", [1, 4])
def test_rate_holds_for_the_whole_job(spark, tmp_path, tasks):
    df = spark.createDataFrame([(f"h{i}", "t") for i in range(24)], "transcript_hash string, transcript string")
    rate = 12.0
    rows = infer.run_responder(df, recorder(str(tmp_path)), 1, partitions=tasks, rate_per_sec=rate).collect()
    begun = sorted(r.finished_at - r.latency_ms / 1000 for r in rows)
    assert len(begun) == 24
    # 24 calls at 12 a second take 23/12 seconds, whatever the number of tasks; and none of the seconds holds more
    assert begun[-1] - begun[0] >= 23 / rate - 0.3
    assert max(sum(b <= x < b + 1 for x in begun) for b in begun) <= rate + tasks
    if tasks > 1:
        assert begun[-1] - begun[0] <= 23 / rate + 1.5
