"""The store's commits: what they touch, two writers, lookups without a scan, change feed, standing leaderboard, edits."""

import json
import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from callsift import schema as S
from callsift.operators import files, partition_store as P, store
from callsift.operators.leaderboard import from_score_counts, leaderboard
from callsift.session import work_dir

def at(text="2026-05-01 00:00:00"):
    return F.to_timestamp(F.lit(text))


def rows(spark, ids, score=3, day=None, teller="T1", text="text of", hash_of="h"):
    """Calls numbered ``ids``: call i falls on day i % 4 + 1, all scored ``score`` (None: no analysis)."""
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    date = F.format_string("2026-01-%02d 10:00:00", F.col("i") % 4 + 1 if day is None else F.lit(day).cast("long"))
    scores = {d: {"score": score if d == "pitch" else 0, "reason": ""} for d in S.DIMENSIONS}
    text_of = json.dumps({"extraction": {"site_visit_outcome": "declined", "preferred_locations": []}, "quality_scores": scores, "summary": "s"})
    analysis = F.from_json(F.lit(text_of), S.ANALYSIS) if score is not None else F.lit(None).cast(S.ANALYSIS)
    return df.select(
        F.format_string("C%05d", "i").alias("call_id"), F.lit(teller).alias("telecaller_id"), F.lit("n" + teller).alias("telecaller_name"),
        F.lit("L").alias("lead_id"), F.lit("ln").alias("lead_name"), F.lit(60).cast("long").alias("duration_sec"), F.to_timestamp(date).alias("ts"),
        F.concat(F.lit(text), "i").alias("transcript"), analysis.alias("analysis"), F.lit(None if score is None else score / 4).cast("double").alias("overall_score"),
        F.lit(score).cast("int").alias("score_quarters"), F.concat(F.lit(hash_of), "i").alias("transcript_hash"))


@pytest.fixture
def root(spark):
    return work_dir(spark, f"test-store-{uuid.uuid4().hex[:8]}")


def state(spark, root, number=None):
    return {r.call_id: (r.transcript, r.score_quarters, r.transcript_hash, str(r.created_at), str(r.call_date)) for r in P.calls(spark, root, number).collect()}


def scanned(df):
    """Rows that the plan's file scans gave."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.length())]
    return total


def test_one_call_touches_one_date_and_its_buckets(spark, root):
    assert P.merge(spark, root, rows(spark, range(200)), at()) == 1
    one = P.version(spark, root)
    before = state(spark, root)
    # call 5 comes again with another day, text, hash and score: it keeps its day and text (Q11)
    again = rows(spark, [5], score=1, day=9, text="other", hash_of="new")
    assert P.merge(spark, root, again, at("2026-06-01 00:00:00")) == 2
    two = P.version(spark, root)
    assert {d for d in two.data if two.data[d] != one.data.get(d)} == {"2026-01-02"} and two.data.keys() == one.data.keys()
    assert len([b for b in two.by_id if two.by_id[b] != one.by_id[b]]) == 1
    assert len([b for b in two.by_hash if two.by_hash[b] != one.by_hash.get(b)]) <= 2
    after = state(spark, root)
    assert {k: v for k, v in after.items() if k != "C00005"} == {k: v for k, v in before.items() if k != "C00005"}
    assert after["C00005"] == ("text of5", 1, "new5", "2026-05-01 00:00:00", "2026-01-02")
    # readers of the first version see it as it was
    assert state(spark, root, 1) == before
    # the old hash is gone, the new one leads to the call
    hashes = spark.createDataFrame([("h5",), ("new5",), ("h6",)], "transcript_hash string")
    assert {r.transcript_hash: r.cached_call_id for r in P.cache_lookup(spark, root, hashes).collect()} == {"h5": None, "new5": "C00005", "h6": "C00006"}


def test_two_writers_lose_no_row(spark, root):
    P.merge(spark, root, rows(spark, range(20)), at())
    failed = []

    def write(k):
        try:
            for n in range(2):
                P.merge(spark, root, rows(spark, [n, 1000 * k + n], score=k), at())
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and P.version(spark, root).number == 5
    got = state(spark, root)
    assert len(got) == 24 and all(got[f"C{1000 * k + n:05d}"][1] == k for k in (1, 2) for n in range(2))
    assert all(got[f"C{n:05d}"][1] in (1, 2) for n in range(2))
    assert sum(r.calls for r in P.score_counts(spark, root).collect()) == 24
    assert P.entries(spark, root, P.version(spark, root), "by_id").count() == P.entries(spark, root, P.version(spark, root), "by_hash").count() == 24


def test_the_slower_writer_starts_again(spark, root, monkeypatch):
    P.merge(spark, root, rows(spark, range(4)), at())
    real, other = files.create_once, []

    def create(spark_, path, text):
        if not other:  # another writer commits just before
            other.append(True)
            assert P.merge(spark, root, rows(spark, [0, 50], score=5), at()) == 2
        return real(spark_, path, text)

    monkeypatch.setattr(files, "create_once", create)
    assert P.merge(spark, root, rows(spark, [1, 60], score=4), at()) == 3
    got = state(spark, root)
    assert [got[c][1] for c in ("C00000", "C00050", "C00001", "C00060", "C00002")] == [5, 5, 4, 4, 3]


def test_create_once(spark, root):
    for scheme in ("", "file:"):
        path = f"{scheme}{root}/m{len(scheme)}/1.json"
        assert files.create_once(spark, path, "a") and not files.create_once(spark, path, "b")
        assert files.read_text(spark, path) == "a" and files.names(spark, os.path.dirname(path)) == ["1.json"]
    # the way of other file systems
    hidden, _ = files._path(spark, f"{root}/m0/.x")
    for text, want in (("c", True), ("d", False)):
        with open(f"{root}/m0/.x", "w") as f:
            f.write(text)
        assert files._rename(spark, hidden, files._path(spark, f"{root}/m0/2.json")[0]) is want


def test_lookup_reads_no_more_than_it_needs(spark, root):
    n = 20_000
    P.merge(spark, root, rows(spark, range(n)), at())
    keys = spark.createDataFrame([(f"h{i}",) for i in range(0, 300, 3)] + [("none",)], "transcript_hash string")
    looked = P.cache_lookup(spark, root, keys)
    assert looked.filter("cached").count() == 100
    v = P.version(spark, root)
    assert scanned(P.found(spark, root, v, keys.limit(1), "by_hash")) <= n / P.BUCKETS * 2
    # keys that no row group can hold are not read at all: bloom filters
    missing = spark.createDataFrame([(f"h{i}x",) for i in range(50)], "transcript_hash string")
    assert scanned(P.found(spark, root, v, missing, "by_hash")) <= n * 0.1
    one = P.lookup(spark, root, spark.createDataFrame([("C00007",), ("nobody",)], "call_id string"))
    assert [r.call_id for r in one.collect()] == ["C00007"]
    assert all("call_date=2026-01-04" in f for f in one.inputFiles() if "/data/" in f)


def test_more_keys_than_a_filter_names(spark, root, monkeypatch):
    monkeypatch.setattr(P, "NAMED_KEYS", 5)
    P.merge(spark, root, rows(spark, range(50)), at())
    keys = spark.createDataFrame([(f"C{i:05d}",) for i in range(40, 60)] + [(None,)], "call_id string")
    assert P.lookup(spark, root, keys).count() == 10
    assert sorted(r.call_id for r in P.unseen(spark, root, keys.where("call_id is not null")).collect()) == [f"C{i:05d}" for i in range(50, 60)]


def test_first_stored_call_answers_for_a_hash(spark, root):
    same = rows(spark, [3, 1], text="x").withColumn("transcript_hash", F.lit("same"))
    P.merge(spark, root, same, at())
    P.merge(spark, root, rows(spark, [0]).withColumn("transcript_hash", F.lit("same")), at("2026-06-01 00:00:00"))
    got = P.cache_lookup(spark, root, spark.createDataFrame([("same",)], "transcript_hash string")).first()
    assert got.cached_call_id == "C00001"


def test_changes_are_seen_once(spark, root, tmp_path):
    seen = []
    follow = lambda: P.follow(spark, root, lambda df, n: seen.extend((n, r.call_id, r.change, r.score_quarters) for r in df.collect()), str(tmp_path / "ckpt"))
    P.merge(spark, root, rows(spark, range(6)), at())
    follow()
    P.merge(spark, root, rows(spark, [2, 6], score=5), at())
    edits = spark.createDataFrame([("C00001", "quality_scores.pitch.score", "0"), ("nobody", "summary", "x")], "call_id string, field string, value string")
    number, bad = P.edit(spark, root, edits.withColumn("edited_at", at()))
    assert number == 3 and [(r.call_id, r.reason) for r in bad.collect()] == [("nobody", "call not found")]
    follow()
    follow()
    assert sorted(seen) == [(1, f"C{i:05d}", "insert", 3) for i in range(6)] + [(2, "C00002", "update", 5), (2, "C00006", "insert", 5), (3, "C00001", "update", 0)]
    both = {(r.call_id, r.change, r.score_quarters) for r in P.changes(spark, root, 1, 3).collect()}
    assert both == {("C00002", "update", 5), ("C00006", "insert", 5), ("C00001", "update", 0)}
    # an edit leaves the dates of other calls alone
    two, three = P.version(spark, root, 2), P.version(spark, root, 3)
    assert [d for d in three.data if three.data[d] != two.data[d]] == ["2026-01-02"] and three.by_id == two.by_id


def test_standing_leaderboard_equals_the_full_one(spark, root):
    for k in range(5):
        batch = rows(spark, range(k * 3, k * 3 + 9), score=k, teller=f"T{k % 2}").unionByName(rows(spark, [900 + k], score=None, teller="T9"))
        P.merge(spark, root, batch, at())
        counts = P.score_counts(spark, root)
        assert all("/scores/" in f for f in counts.inputFiles())
        table = lambda df: sorted(tuple(r) for r in df.collect())
        assert table(from_score_counts(counts)) == table(leaderboard(P.calls(spark, root)))
        assert P.total_calls(spark, root).first().n == P.calls(spark, root).count()


def test_epochs_and_empty_batches(spark, root):
    assert P.merge(spark, root, rows(spark, []), at()) == 0 and P.calls(spark, root).count() == 0
    assert P.total_calls(spark, root).first().n == 0
    assert P.merge(spark, root, rows(spark, []), at(), stream=("s", 0)) == 1
    assert P.merge(spark, root, rows(spark, [1]), at(), stream=("s", 1)) == 2
    assert P.merge(spark, root, rows(spark, [2]), at(), stream=("s", 1)) == 2  # that epoch is in
    assert P.merge(spark, root, rows(spark, [3]), at(), stream=("other", 1)) == 3
    assert sorted(state(spark, root)) == ["C00001", "C00003"]
    # a call without a time has a folder of its own
    P.merge(spark, root, rows(spark, [4]).withColumn("ts", F.lit(None).cast("timestamp")), at())
    P.merge(spark, root, rows(spark, [4], score=1), at())
    assert state(spark, root)["C00004"][1] == 1 and state(spark, root)["C00004"][4] == "None"


def test_typed_edits(spark):
    st = rows(spark, [1, 2]).withColumn("created_at", at())
    long = "é" * 700
    edits = [("C00001", "extraction.budget_range", '{"min_lakhs": "60", "max_lakhs": 40}'), ("C00001", "extraction.preferred_locations", '[" OMR ", "", 5, null]'),
             ("C00001", "quality_scores.pitch.reason", long), ("C00001", "summary", long), ("C00001", "next_action_reason", " kept as it is "),
             ("C00002", "extraction.budget_range", '{"min_lakhs": [1]}'), ("C00002", "extraction.budget_range", "cheap"), ("C00002", "extraction.preferred_locations", "OMR"),
             ("C00002", "summary", None), ("C00002", "extraction.budget_range.min_lakhs", "5"), ("C00002", "extraction", "{}")]
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(edits)], "call_id string, field string, value string, edit_id int").withColumn("edited_at", at())
    out, bad = store.apply_edits(st, df)
    got = {r.call_id: r for r in out.collect()}
    a = got["C00001"].analysis
    assert tuple(a.extraction.budget_range) == (40.0, 60.0) and a.extraction.preferred_locations == ["OMR", "5", "None"]
    assert (len(a.quality_scores.pitch.reason), len(a.summary), a.next_action_reason) == (400, 600, " kept as it is ")
    assert not got["C00002"].edited and sorted(r.edit_id for r in bad.collect()) == [5, 6, 7, 8, 9, 10]
    # the budget is taken away again; edits as variants
    more = df.limit(0).unionByName(spark.createDataFrame([("C00001", "extraction.budget_range", '"not_discussed"', 1), ("C00001", "summary", "5", 2), ("C00001", "summary", '{"a": 1}', 3),
                                                          ("C00001", "quality_scores.pitch.score", "2.5", 4), ("C00001", "extraction.timeline", '"immediate"', 5)],
                                                         "call_id string, field string, value string, edit_id int").withColumn("edited_at", at()))
    out2, bad2 = store.apply_edits(out.drop("edited"), more.withColumn("value", F.parse_json("value")))
    b = {r.call_id: r for r in out2.collect()}["C00001"].analysis
    assert b.extraction.budget_range is None and b.summary == "5" and b.quality_scores.pitch.score == 2 and b.extraction.timeline == "immediate"
    assert [r.edit_id for r in bad2.collect()] == [3]


def test_readers_prune_dates(spark, root):
    P.merge(spark, root, rows(spark, range(40)), at())
    q = P.calls(spark, root).where("call_date = date'2026-01-03'").select("call_id")
    assert q.count() == 10
    assert "transcript" not in q._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1].split("\n")[0]
    assert P.calls(spark, root, dates=["2026-01-01", "2030-01-01"]).count() == 10
