"""Skip-seen, cache lookup by content hash, in-batch duplicates.

Dedup by content uses grouped minimums rather than windows: a window over a
hot hash would put all of its rows in one task, while ``groupBy(hash).min``
combines map-side and shuffles one row per hash per task.  The join back to
the per-hash representative is an equi-join that AQE's skew handling can
split when one hash holds a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def skip_seen(batch: DataFrame, store: DataFrame, key: str = "call_id", force: bool = False) -> DataFrame:
    """Rows of the batch whose key is not stored yet (J1); ``force`` keeps all."""
    if force:
        return batch
    return batch.join(store.select(key), key, "left_anti")


def hash_representatives(store: DataFrame, hash_col: str = "transcript_hash", key: str = "call_id",
                         created: str | None = "created_at") -> DataFrame:
    """One stored row per hash: earliest created, then smallest key (Q12)."""
    if created:
        agg = F.min(F.struct(F.col(created), F.col(key))).alias("_first")
        return store.groupBy(hash_col).agg(agg).select(hash_col, F.col(f"_first.{key}").alias("cached_call_id"))
    return store.groupBy(hash_col).agg(F.min(key).alias("cached_call_id"))


def cache_lookup(batch: DataFrame, store: DataFrame, hash_col: str = "transcript_hash", key: str = "call_id",
                 created: str | None = "created_at") -> DataFrame:
    """Flag batch rows whose content is already stored and name the stored call."""
    reps = hash_representatives(store, hash_col, key, created)
    out = batch.join(reps, hash_col, "left")
    return out.withColumn("cached", F.col("cached_call_id").isNotNull())


def in_batch_duplicates(batch: DataFrame, hash_col: str, order_key: str) -> DataFrame:
    """Mark the first row per hash (``is_first``) and give every row its representative."""
    reps = batch.groupBy(hash_col).agg(F.min(order_key).alias("first_key"))
    out = batch.join(reps, hash_col)
    return out.withColumn("is_first", F.col(order_key) == F.col("first_key"))
