"""Call store that commits per partition.

A version of the store is a manifest that names, for each part, the commit whose folder holds it:

    data/commit=<id>/call_date=<date>/     calls; one folder per date that the commit changed
    by_id/commit=<id>/bucket=<b>/          call_id -> hash, date, creation time, in ``buckets`` buckets
    by_hash/commit=<id>/bucket=<b>/        the same rows by transcript hash, with Parquet bloom filters
    scores/commit=<id>/                    number of calls per telecaller and score
    manifest/<version>.json

A merge finds the dates of its calls through ``by_id``, reads and writes those dates and those
buckets only, and then creates the next manifest, which only one writer can do; the other reads the new
version and starts again from it.  Files are never changed, so readers of a version keep it, and a writer that
dies leaves the store as it was.  A stream names itself and its epoch; an epoch that is in the store is not
merged again.

A manifest has one entry per date and bucket, whatever the number of calls.  What a merge brings to the driver
is the dates and bucket numbers that it touches.  A call's row carries the commit that created and
the one that last changed it, so the rows changed between two versions are a filter on the folders that
differ.  ``scores`` is kept by adding what a commit brings and taking away what it replaces, so the
leaderboard reads no call.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schema as S
from ..session import kept
from . import files, store

#: Buckets of a new store's side tables; some 10^7 calls each are well sized, so a large store is begun with more.
BUCKETS = 16
#: Keys that a lookup may name in the filter of the scan; more are found by bucket and join alone.
NAMED_KEYS = 1000
ATTEMPTS = 20
NO_DATE = "__HIVE_DEFAULT_PARTITION__"

ENTRY = T.StructType([T.StructField("call_id", T.StringType()), T.StructField("transcript_hash", T.StringType()), T.StructField("call_date", T.DateType()),
                      T.StructField("created_at", T.TimestampType()), T.StructField("bucket", T.IntegerType()), T.StructField("commit", T.StringType())])
MARKS = [T.StructField("created_in", T.StringType()), T.StructField("changed_in", T.StringType())]
_STORED = T.StructType([f for f in S.STORED_CALL.fields if f.name != "call_date"] + MARKS + [T.StructField("call_date", T.DateType()), T.StructField("commit", T.StringType())])
SCORES = "telecaller_id string, telecaller_name string, score_quarters int, calls long"


class StoreBusy(RuntimeError):
    """Other writers were faster in every attempt."""


@dataclass
class Version:
    """A manifest: which commit holds each date and bucket."""

    number: int = 0
    commit: str = ""
    buckets: int = BUCKETS
    data: dict[str, str] = field(default_factory=dict)
    by_id: dict[str, str] = field(default_factory=dict)
    by_hash: dict[str, str] = field(default_factory=dict)
    scores: str = ""
    #: stream -> [its last epoch in the store, the version that the epoch began with]
    epochs: dict[str, list[int]] = field(default_factory=dict)


def _manifest(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/manifest/{number:012d}.json"


def version(spark: SparkSession, root: str, number: int | None = None, buckets: int = BUCKETS) -> Version:
    """A version of the store, the newest unless ``number`` is given; version 0 is the empty store."""
    if number is None:
        known = [n for n in files.names(spark, f"{root.rstrip('/')}/manifest") if n.endswith(".json") and not n.startswith(".")]
        number = int(known[-1].split(".")[0]) if known else 0
    return Version(**json.loads(files.read_text(spark, _manifest(root, number)))) if number else Version(buckets=buckets)


# ------------------------------------------------------------------ reading
def _folders(spark: SparkSession, root: str, kind: str, schema: T.StructType, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    base = f"{root.rstrip('/')}/{kind}"
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{p}" for p in parts])


def marked_calls(spark: SparkSession, root: str, v: Version, dates: list[str] | None = None) -> DataFrame:
    """The calls of some dates (None: all), with the commits that created and changed them."""
    some = v.data if dates is None else {d: v.data[d] for d in dates if d in v.data}
    return _folders(spark, root, "data", _STORED, [f"commit={c}/call_date={d}" for d, c in sorted(some.items())]).drop("commit")


def calls(spark: SparkSession, root: str, number: int | None = None, dates: list[str] | None = None) -> DataFrame:
    """Stored calls (``schema.STORED_CALL``) of a version; filters on call_date prune folders."""
    rows = marked_calls(spark, root, version(spark, root, number), dates)
    return rows.select(*[f.name for f in S.STORED_CALL.fields])


def entries(spark: SparkSession, root: str, v: Version, kind: str, buckets: list[int] | None = None) -> DataFrame:
    """Rows of the side table ``by_id`` or ``by_hash`` in some buckets (None: all)."""
    table = getattr(v, kind)
    some = table if buckets is None else {str(b): table[str(b)] for b in buckets if str(b) in table}
    return _folders(spark, root, kind, ENTRY, [f"commit={c}/bucket={b}" for b, c in sorted(some.items())]).drop("commit")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def found(spark: SparkSession, root: str, v: Version, keys: DataFrame, kind: str) -> DataFrame:
    """Side table rows whose key (call_id for ``by_id``, else transcript_hash) is among ``keys``.

    Only the keys' buckets are read.  Up to ``NAMED_KEYS`` keys are named in the scan's filter too, where the row groups'
    bloom filters and statistics skip what cannot hold them.
    """
    column = "call_id" if kind == "by_id" else "transcript_hash"
    keys = keys.select(column).where(F.col(column).isNotNull()).distinct()
    placed = keys.select(column, bucket_of(F.col(column), v.buckets).alias("_bucket"))
    some = placed.limit(NAMED_KEYS + 1).collect()
    if len(some) <= NAMED_KEYS:
        return entries(spark, root, v, kind, sorted({r[1] for r in some})).where(F.col(column).isin([r[0] for r in some]))
    touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())  # v.buckets numbers at most
    return entries(spark, root, v, kind, touched).join(keys, column, "left_semi")


def representatives(spark: SparkSession, root: str, v: Version, hashes: DataFrame) -> DataFrame:
    """transcript_hash, cached_call_id, call_date of the first stored call of each hash (J2, Q12), without reading calls."""
    first = F.min(F.struct("created_at", "call_id", "call_date")).alias("_first")
    return found(spark, root, v, hashes, "by_hash").groupBy("transcript_hash").agg(first).select(
        "transcript_hash", F.col("_first.call_id").alias("cached_call_id"), F.col("_first.call_date").alias("call_date"))


def cache_lookup(spark: SparkSession, root: str, batch: DataFrame, number: int | None = None) -> DataFrame:
    """``batch`` (transcript_hash, ...) with cached and cached_call_id."""
    first = representatives(spark, root, version(spark, root, number), batch).select("transcript_hash", "cached_call_id")
    return batch.join(first, "transcript_hash", "left").withColumn("cached", F.col("cached_call_id").isNotNull())


def unseen(spark: SparkSession, root: str, batch: DataFrame, number: int | None = None) -> DataFrame:
    """Rows of ``batch`` whose call_id is not stored."""
    return batch.join(found(spark, root, version(spark, root, number), batch, "by_id").select("call_id"), "call_id", "left_anti")


def _dates(rows: DataFrame, column: str = "call_date") -> list[str]:
    """The dates in ``rows`` as folder names: a number bounded by the days that the store spans."""
    return sorted(r[0] for r in rows.select(F.coalesce(F.col(column).cast("string"), F.lit(NO_DATE))).distinct().collect())


def lookup(spark: SparkSession, root: str, keys: DataFrame, number: int | None = None) -> DataFrame:
    """Stored calls by call_id (P3): the side table gives the dates, only those are read."""
    v = version(spark, root, number)
    places = found(spark, root, v, keys, "by_id").select("call_id", "call_date")
    rows = marked_calls(spark, root, v, _dates(places)).select(*[f.name for f in S.STORED_CALL.fields])
    return rows.join(places.select("call_id"), "call_id", "left_semi")


def total_calls(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """One row n: the calls of a version (S9, A8), from the score counts."""
    return score_counts(spark, root, number).agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("n"))


def score_counts(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """telecaller_id, telecaller_name, score_quarters, calls of a version: at most 22 rows per telecaller."""
    v = version(spark, root, number)
    return spark.read.schema(SCORES).parquet(f"{root.rstrip('/')}/scores/commit={v.scores}") if v.scores else spark.createDataFrame([], SCORES)


# ------------------------------------------------------------------ writing
def _write(df: DataFrame, root: str, kind: str, commit: str, by: str, order: str) -> list[str]:
    """Write the parts of a commit, one folder per value of ``by``, and return those values' folder names."""
    path = f"{root.rstrip('/')}/{kind}/commit={commit}"
    (df.sortWithinPartitions(by, order).write.option("parquet.bloom.filter.enabled#transcript_hash", "true")
     .option("parquet.bloom.filter.enabled#call_id", "true").partitionBy(by).parquet(path))
    return [n.split("=", 1)[1] for n in files.names(df.sparkSession, path) if n.startswith(f"{by}=")]


def _touched(fresh: DataFrame, gone: DataFrame, buckets: int) -> dict[str, list[int]]:
    """The buckets of both side tables that gain or lose rows: twice ``buckets`` numbers at most."""
    out = {"by_id": [], "by_hash": []}
    both = fresh.select("call_id", "transcript_hash").unionByName(gone)
    kinds = F.array(F.struct(F.lit("by_id").alias("kind"), bucket_of(F.col("call_id"), buckets).alias("bucket")),
                    F.struct(F.lit("by_hash").alias("kind"), bucket_of(F.col("transcript_hash"), buckets).alias("bucket")))
    for r in both.select(F.inline(kinds)).distinct().collect():
        out[r.kind].append(r.bucket)
    return out


def _index(spark: SparkSession, root: str, v: Version, commit: str, kind: str, touched: list[int], fresh: DataFrame, gone: DataFrame) -> dict[str, str]:
    """Rewrite the touched buckets of a side table with its new rows (``fresh``) and without the old ones (``gone``)."""
    column = "call_id" if kind == "by_id" else "transcript_hash"
    kept_rows = entries(spark, root, v, kind, touched).join(gone.select("call_id"), "call_id", "left_anti")
    rows = kept_rows.drop("bucket").unionByName(fresh).withColumn("bucket", bucket_of(F.col(column), v.buckets))
    written = _write(rows.repartition(max(1, len(touched)), "bucket"), root, kind, commit, "bucket", column)
    return {b: c for b, c in getattr(v, kind).items() if int(b) not in touched} | {b: commit for b in written}


def _count(rows: DataFrame, sign: int) -> DataFrame:
    return rows.groupBy("telecaller_id", "telecaller_name", "score_quarters").agg((F.count(F.lit(1)) * sign).alias("calls"))


def _commit(spark: SparkSession, root: str, change: Callable[[DataFrame, str], DataFrame], dates: Callable[[Version], list[str]], index: bool,
            stream: tuple[str, int] | None, buckets: int) -> int:
    """Apply ``change`` to the newest version until no other writer is in between; the number of the new version.

    ``dates`` names the dates that the change may touch; ``change`` makes their new rows of their old ones (marked calls) and the commit's name.
    """
    base_root = root.rstrip("/")
    for _ in range(ATTEMPTS):
        v = version(spark, root, buckets=buckets)
        if stream and v.epochs.get(stream[0], [-1])[0] >= stream[1]:
            return v.number
        commit = uuid.uuid4().hex
        touched = dates(v)
        old = marked_calls(spark, root, v, touched)
        # a date is spread over the tasks of the merge's join and written as several files if it is large
        written = _write(change(old, commit), root, "data", commit, "call_date", "call_id")
        new = Version(v.number + 1, commit, v.buckets, {d: c for d, c in v.data.items() if d not in touched} | {d: commit for d in written},
                      v.by_id, v.by_hash, commit, dict(v.epochs))
        now = marked_calls(spark, root, new, written)
        changed = now.where(F.col("changed_in") == commit)
        before = old.join(changed.select("call_id"), "call_id", "left_semi")
        counts = score_counts(spark, root, v.number).unionByName(_count(changed, 1)).unionByName(_count(before, -1))
        counts = counts.groupBy("telecaller_id", "telecaller_name", "score_quarters").agg(F.sum("calls").alias("calls")).where("calls <> 0")
        counts.write.parquet(f"{base_root}/scores/commit={commit}")
        if index:
            fresh = changed.select("call_id", "transcript_hash", "call_date", "created_at")
            gone = before.select("call_id", "transcript_hash")
            touched = _touched(fresh, gone, v.buckets)
            new.by_id = _index(spark, root, v, commit, "by_id", touched["by_id"], fresh, gone)
            new.by_hash = _index(spark, root, v, commit, "by_hash", touched["by_hash"], fresh, gone)
        if stream:
            new.epochs[stream[0]] = [stream[1], v.number]
        if files.create_once(spark, _manifest(root, new.number), json.dumps(asdict(new))):
            return new.number
    raise StoreBusy(f"{ATTEMPTS} attempts to commit to {root} failed")


def merge(spark: SparkSession, root: str, batch: DataFrame, batch_ts: Column, stream: tuple[str, int] | None = None, buckets: int = BUCKETS) -> int:
    """Upsert ``batch`` by call_id (M1 M4, Q11) and return the number of the new version.

    ``batch``: one row per call_id, the columns of ``store.KEEP_COLS`` and ``store.UPDATE_COLS``.  A stored call keeps
    its time, hence its date.  ``stream`` (name, epoch) makes the merge of an epoch happen once.
    """
    batch = kept(batch.select("call_id", *store.KEEP_COLS, *store.UPDATE_COLS), "batch")

    def dates(v: Version) -> list[str]:
        known = found(spark, root, v, batch, "by_id").select("call_id", F.col("call_date").alias("_date"), F.lit(True).alias("_known"))
        placed = batch.select("call_id", "ts").join(known, "call_id", "left")
        return _dates(placed.select(F.when(F.col("_known"), F.col("_date")).otherwise(F.to_date("ts")).alias("call_date")))

    if batch.isEmpty() and not stream:
        return version(spark, root).number
    return _commit(spark, root, lambda old, commit: store.merge_calls(old, batch, batch_ts, commit), dates, True, stream, buckets)


def edit(spark: SparkSession, root: str, edits: DataFrame, stream: tuple[str, int] | None = None) -> tuple[int, DataFrame]:
    """Apply a batch of edits (M2 M3): (number of the new version, quarantine).  Only the edited calls' dates are read and written."""
    edits = kept(edits, "edits")
    rejected = {}

    def dates(v: Version) -> list[str]:
        return _dates(found(spark, root, v, edits, "by_id"))

    def change(old: DataFrame, commit: str) -> DataFrame:
        out, bad = store.apply_edits(old, edits)
        rejected["rows"] = bad
        return out.withColumn("changed_in", F.when(F.col("edited"), F.lit(commit)).otherwise(F.col("changed_in"))).drop("edited")

    number = _commit(spark, root, change, dates, False, stream, BUCKETS)
    return number, rejected["rows"] if rejected else edits.limit(0).withColumn("reason", F.lit(""))


# ------------------------------------------------------------------ change feed
def changes(spark: SparkSession, root: str, after: int, upto: int) -> DataFrame:
    """The calls that versions ``after`` + 1 to ``upto`` inserted or changed, as they are in ``upto``, with column ``change``.

    Only date folders that those versions wrote are read.
    """
    made = [version(spark, root, n).commit for n in range(after + 1, upto + 1)]
    v = version(spark, root, upto)
    rows = marked_calls(spark, root, v, [d for d, c in v.data.items() if c in set(made)]).where(F.col("changed_in").isin(made))
    change = F.when(F.col("created_in").isin(made), "insert").otherwise("update")
    return rows.select(*[f.name for f in S.STORED_CALL.fields], change.alias("change"))


def follow(spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand the changes of every version not seen under ``checkpoint`` to ``handle(rows, number)``, one version after the other.

    The manifests are the stream: the file source remembers which it has read, so each version is handed on once
    (again, under the same number, only if ``handle`` failed half way).
    """
    source = (spark.readStream.schema("number long, commit string").option("maxFilesPerTrigger", 1)
              .option("pathGlobFilter", "*.json").json(f"{root.rstrip('/')}/manifest"))

    def batch(df: DataFrame, _: int) -> None:
        for number in sorted(r[0] for r in df.select("number").collect()):  # one manifest
            handle(changes(spark, root, number - 1, number), number)

    source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
