"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

1. A window as long as an item is looked at from every word from which it holds as many of
   that item's five-word shingles, in any order, as the similarity needs; no other window can reach it.
   A text shorter than the item is a window as a whole.
2. Windows and items have 64-bit SimHash fingerprints over their words.  The fingerprint
   is cut into ``RADIUS + 1`` blocks: two that differ in at most ``RADIUS`` bits agree in
   a block, so equality joins on (size, block, value) find all of them.
3. Candidates within the radius are compared by the weighted Jaccard similarity of their
   shingles (sum of minima over sum of maxima); 0.8 or more is contamination.

The table of item shingles, and the keys of the texts that hold windows, are broadcast up
to ``BROADCAST_ROWS`` rows, beyond it Spark shuffles.  Copies of a text are looked at once for each doc_id.

Nulls: rows with a null or empty text or a null doc_id, and items with a null text or
fewer than five words, match nothing.  Rows that repeat give one row; an item_id with several
texts is matched by each.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 15
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Hashes of the words (letters and digits, in lower case) of a text."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingles(w: Column, k: int = SHINGLE) -> Column:
    """Hashes of k words in a row; ``w`` is a plain column of word hashes, as it is read for every element."""
    at = F.sequence(F.lit(0), F.size(w) - k)
    return F.when(F.size(w) >= k, F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))).otherwise(F.array().cast("array<bigint>"))


def fingerprints(rows: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and fp: the SimHash of the words w, each occurrence with weight one."""
    each = rows.select(*key, F.explode("w").alias("h"))
    bits = [F.sum(F.shiftright("h", b).bitwiseAND(1)).alias(f"b{b}") for b in range(64)]
    sums = each.groupBy(key).agg(F.count("*").alias("all"), *bits)
    one = [F.when(F.col(f"b{b}") * 2 > F.col("all"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return sums.select(*key, reduce(lambda x, y: x.bitwiseOR(y), one).alias("fp"))


def blocks(rows: DataFrame, radius: int) -> DataFrame:
    """A row per block of the fingerprint: (block, value)."""
    n = radius + 1
    cut = [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", lo).bitwiseAND((1 << (hi - lo)) - 1).alias("value")) for i, (lo, hi) in enumerate(cut)]
    return rows.withColumn("part", F.explode(F.array(*parts))).select("*", "part.*").drop("part")


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start_word: the best window of each document for each item that it holds."""
    items = items.where("item_id is not null and text is not null").select("item_id", F.xxhash64("text").alias("v"), words(F.col("text")).alias("w"))
    items = items.where(F.size("w") >= SHINGLE).withColumn("n", F.size("w"))
    item = ["item_id", "v"]
    items = written(items.dropDuplicates(item), "leak-items")
    each = items.select(*item, "n", F.explode(shingles(F.col("w"))).alias("h"))
    item_sh = written(each.groupBy(*item, "n", "h").agg(F.count("*").alias("c")), "leak-shingles")
    side = F.broadcast(item_sh) if item_sh.count() <= BROADCAST_ROWS else item_sh

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tid", F.xxhash64("text"))
    spelt = texts.select("doc_id", "tid", words(F.col("text")).alias("w"))
    hits = (spelt.select("doc_id", "tid", F.posexplode(shingles(F.col("w"))).alias("p", "h")).join(side, "h")
            .groupBy("doc_id", "tid", *item, "n", "h", "c").agg(F.collect_set("p").alias("at")))
    held = hits.groupBy("doc_id", "tid", *item, "n").agg(F.sum("c").alias("held"), F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    held = written(held.where(F.col("held") >= F.ceil(similarity * (F.col("n") - SHINGLE + 1))), "leak-held")
    key = ["doc_id", "tid", "n", "start"]
    keys = held.select("doc_id", "tid").distinct()
    keys = F.broadcast(keys) if held.count() <= BROADCAST_ROWS else keys  # else the texts are shuffled
    some = texts.join(keys, ["doc_id", "tid"], "left_semi").dropDuplicates(["doc_id", "tid"])
    some = written(some.select("doc_id", "tid", words(F.col("text")).alias("all")), "leak-texts")
    # starts whose first shingle of the item is at[i] and whose window holds the least number of them
    size = F.col("n") - SHINGLE + 1
    least = F.ceil(2 * similarity / (1 + similarity) * size - 1e-9).cast("int")
    spans = held.join(some.select("doc_id", "tid", F.size("all").alias("size")), ["doc_id", "tid"]).withColumn("least", least)
    first = F.transform("at", lambda p, i: F.struct(
        F.greatest(F.lit(0), F.get("at", i + F.col("least") - 1) - size + 1, F.coalesce(F.when(i > 0, F.get("at", i - 1) + 1), F.lit(0))).alias("lo"),
        F.least(p, F.col("size") - F.col("n")).alias("hi"), F.get("at", i + F.col("least") - 1).isNotNull().alias("full")))
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(True).alias("full")))
    spans = spans.select("doc_id", "tid", "n", F.explode(F.when(F.col("size") <= F.col("n"), whole).otherwise(F.filter(first, lambda x: x["full"] & (x["lo"] <= x["hi"])))).alias("span"))
    wanted = spans.select("doc_id", "tid", "n", F.explode(F.sequence("span.lo", "span.hi")).alias("start")).distinct()
    windows = some.join(wanted, ["doc_id", "tid"]).select(*key, F.slice("all", F.col("start") + 1, F.col("n")).alias("w"))
    windows = written(windows, "leak-windows")

    ours = blocks(fingerprints(windows, key), radius)
    theirs = blocks(fingerprints(items, [*item, "n"]), radius).withColumnRenamed("fp", "item_fp")
    near = ours.join(theirs, ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = near.select(*key, *item).distinct()
    window_sh = windows.select(*key, F.size("w").alias("m"), F.explode(shingles(F.col("w"))).alias("h")).groupBy(*key, "m", "h").agg(F.count("*").alias("own"))
    both = near.join(window_sh, key).join(item_sh.drop("n"), [*item, "h"]).groupBy(*key, "m", *item).agg(F.sum(F.least("own", "c")).alias("common"))
    total = F.col("n") + F.col("m") - 2 * (SHINGLE - 1) - F.col("common")
    found = both.withColumn("similarity", F.col("common") / total).where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("start_word"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    bad = contaminated(docs, items).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long") == F.col("__bad"), "left_anti")
