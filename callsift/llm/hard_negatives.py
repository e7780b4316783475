"""Hard negatives for contrastive training by threshold joins over an inverted index (L2AP-style).

An anchor's positives are its first rows of the same label by inner product; for each positive the
negatives are the first rows of another label whose score lies in a window set by the positive's
score.  Both are one kind of search: a *window* of an anchor asks for the first ``k`` rows of the same
(or another) label with a score in [lo, hi].  All windows are searched together:

1. Each open window has a threshold between lo and hi, guessed from the anchor's scores with a
   sample of ``SAMPLE`` rows so that about 4k rows are expected above it.
2. Rows stand in blocks; a task joins a block of anchors with a few blocks of rows.  A block's
   inverted index has its dimensions in the order of their energy, and of a row only the leading
   ones: where the norm of the rest times the longest anchor stays below every threshold, the rest is
   omitted.  Scores are accumulated list by list, and a pair is dropped as soon as its partial
   score plus the product of the remaining norms is below the anchor's threshold.  What is left is scored exactly.
3. A window that has its k rows, or whose threshold has come down to lo, is done.  The thresholds
   of the others are lowered (8 times the expected rows) and joined again until all windows are full.

The result is exact whatever the sample holds: all rows above a threshold are compared, in
integers, and the last threshold is lo itself.  A task returns at most k rows per window; the anchors are
the stated query set, so the work grows with anchors times rows, as the search's definition does.

Nulls: rows with a null vec_id, label, vector or component take no part, nor do empty vectors.  Rows that share
a vec_id are one: the smallest label, then the smallest vector stands.  Ties of score go to the
smaller vec_id.  Vectors of different lengths are not compared.  Scores must fit 64 bits (an error is raised if not).
An empty table, or one without anchors, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, written

#: Rows that the first thresholds are guessed from; anchors in a block; row blocks in a task; dimensions between two prunings.
SAMPLE, ANCHORS, BLOCKS, CHUNK = 1024, 512, 8, 16
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Pairs compared at once.
PAIRS = 50_000

_RECORD = "dim int, n int, ids binary, labels array<string>, x binary"
_WINDOW = "vec_id long, label string, w int, k int, lo long, hi long, pool long, t long, dim int, x binary"
_HIT = "anchor_id long, w int, vec_id long, score long"


def packed(x: np.ndarray) -> bytes:
    """Integers in 32 bits each if they fit, else in 64."""
    return x.astype("<i4" if not x.size or np.abs(x).max() < 1 << 31 else "<i8").tobytes()


def unpacked(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * n * dim else "<i8").reshape(n, dim).astype(np.int64)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows as 64-bit integers."""
    most = np.sqrt(np.square(q.astype(float)).sum(1).max()) * np.sqrt(np.square(x.astype(float)).sum(1).max())
    if most < 1 << 52:
        return (q.astype(float) @ x.astype(float).T).astype(np.int64)
    s = q.astype(object) @ x.T.astype(object)
    if np.abs(s).max() > HIGHEST:
        raise OverflowError("an inner product does not fit 64 bits")
    return s.astype(np.int64)


class Lists:
    """Inverted index of a block: dimension j lists the first ``count[j]`` rows, those that keep it."""

    def __init__(self, x: np.ndarray, longest: float, lowest: float):
        by = np.argsort(-np.square(x.astype(float)).sum(0), kind="stable")
        v = x[:, by].astype(float)
        rest = suffix_norms(v)
        # dimensions from the first one on whose remaining norm cannot reach a threshold are omitted
        cut = (rest[:, :-1] * longest * (1 + 1e-9) >= lowest).sum(1) if lowest > 0 else np.full(len(x), x.shape[1])
        self.order = np.argsort(-cut, kind="stable")
        self.by, self.cut, self.rest = by, cut[self.order], rest[self.order]
        self.values = np.where(np.arange(x.shape[1]) < self.cut[:, None], v[self.order], 0.0)
        self.count = (self.cut[None, :] > np.arange(x.shape[1])[:, None]).sum(1)

    def candidates(self, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that may score at least the query's threshold."""
        v = q[:, self.by].astype(float)
        rest, low = suffix_norms(v), t.astype(float)[:, None]
        score = np.zeros((len(q), len(self.order)))
        alive = np.ones(score.shape, bool)
        alive[:, self.cut == 0] = False  # not in any list
        for j in range(0, v.shape[1], CHUNK):
            end, n = min(j + CHUNK, v.shape[1]), self.count[j]
            score[:, :n] += v[:, j:end] @ self.values[:n, j:end].T
            at = np.minimum(self.cut, end)  # beyond, a row's part is bounded by its norm
            bound = score + rest[:, at] * self.rest[np.arange(len(at)), at]
            alive &= bound + np.abs(bound) * 1e-9 + 1e-3 >= low
            if alive.mean() < 0.02:
                break
        a, r = np.nonzero(alive)
        return a, self.order[r]


def suffix_norms(v: np.ndarray) -> np.ndarray:
    """Column j: the norm of each row's dimensions from j on."""
    out = np.zeros((len(v), v.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(np.square(v)[:, ::-1], 1)[:, ::-1])
    return out


def reaching(q: np.ndarray, t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of every pair whose score is at least the query's threshold."""
    longest = np.sqrt(np.square(q.astype(float)).sum(1).max())
    a, r = Lists(x, longest, float(t.min())).candidates(q, t)
    if len(a) > 0.1 * len(q) * len(x):
        s = exact_scores(q, x)[a, r]
    else:
        safe = longest * np.sqrt(np.square(x.astype(float)).sum(1).max()) < 1 << 62
        s = np.zeros(len(a), np.int64)
        for i in range(0, len(a), PAIRS):
            one, two = q[a[i:i + PAIRS]], x[r[i:i + PAIRS]]
            s[i:i + PAIRS] = np.einsum("ij,ij->i", one, two) if safe else [exact_scores(m[None], n[None])[0, 0] for m, n in zip(one, two)]
    ok = s >= t[a]
    return a[ok], r[ok], s[ok]


def best(windows: pd.DataFrame, blocks: pd.DataFrame, dim: int, same: bool) -> pd.DataFrame:
    """The first k rows of each window among the rows of some blocks."""
    windows = windows.sort_values(["vec_id", "w"]).reset_index(drop=True)
    start = np.flatnonzero(np.r_[True, np.diff(windows["vec_id"].to_numpy()) != 0])
    q = np.concatenate([unpacked(x, 1, dim) for x in windows["x"].iloc[start]])
    t = np.minimum.reduceat(windows["t"].to_numpy(), start)
    end = np.r_[start[1:], len(windows)]
    w, k, lo, hi, anchor = (windows[c].to_numpy() for c in ("w", "k", "t", "hi", "vec_id"))
    own = windows["label"].to_numpy()
    out = []
    for block in blocks.itertuples():
        ids, labels = np.frombuffer(block.ids, "<i8"), np.array(block.labels, object)
        kinds, at = np.unique(np.concatenate([labels, own[start]]), return_inverse=True)
        label, asked = at[:len(ids)], at[len(ids):]
        a, r, s = reaching(q, t, unpacked(block.x, block.n, dim))
        keep = (label[r] == asked[a]) == same
        keep &= ids[r] != anchor[start][a]
        a, r, s = a[keep], r[keep], s[keep]
        by = np.lexsort((ids[r], ~s, a))  # ~s orders downwards without overflow
        a, r, s = a[by], r[by], s[by]
        first, last = np.searchsorted(a, np.arange(len(start))), np.searchsorted(a, np.arange(len(start)), "right")
        for i in np.flatnonzero(last > first):
            score, found = s[first[i]:last[i]], ids[r[first[i]:last[i]]]
            for j in range(start[i], end[i]):
                inside = np.flatnonzero((score <= hi[j]) & (score >= lo[j]))[:k[j]]
                if len(inside):
                    out.append((np.full(len(inside), anchor[j]), np.full(len(inside), w[j]), found[inside], score[inside]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
    return pd.DataFrame(dict(zip(["anchor_id", "w", "vec_id", "score"], columns)))


def threshold(scores: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, pool: np.ndarray, wider: float) -> list[int]:
    """Per window the score above which, and below hi, about 4 k * wider of the pool's rows are expected; lo at the least."""
    out, normal = [], NormalDist()
    mean, sd = scores.mean(1), scores.std(1)
    for m, d, want, low, high, n in zip(mean, sd, k.tolist(), lo.tolist(), hi.tolist(), pool.tolist()):
        above = 1 - normal.cdf((high - m) / d) if d > 0 else 1.0
        share = above + 4 * want * wider / max(n, 1)
        guess = m + d * normal.inv_cdf(1 - share) if share < 0.5 else -np.inf
        out.append(low if guess <= low else max(low, min(high, int(np.floor(guess)))))
    return out


def first_rows(blocks: DataFrame, windows: DataFrame, same: bool, sample: dict[int, np.ndarray], name: str) -> DataFrame:
    """anchor_id, w, vec_id, score, rank: the first k rows of every window (vec_id, label, w, k, lo, hi, pool, x)."""
    slices = max(1, -(-blocks.count() // BLOCKS))
    todo, wider, parts = written(windows.select("vec_id", "label", "w", "k", "lo", "hi", "pool", "x"), f"{name}-windows"), 1.0, []
    while n := todo.count():
        def guess(it, wider=wider):
            for pdf in it:
                for dim, own in pdf.groupby(pdf["x"].str.len()):
                    x = np.array(own["x"].tolist(), np.int64).reshape(len(own), dim)
                    near = sample.get(dim)
                    t = threshold(x.astype(float) @ near.T, own["k"], own["lo"], own["hi"], own["pool"], wider) if near is not None else own["lo"].tolist()
                    yield own.assign(t=t, dim=dim, x=[packed(v) for v in x])[[c.split()[0] for c in _WINDOW.split(", ")]]

        asked = written(todo.mapInPandas(guess, _WINDOW), f"{name}-thresholds")
        groups = -(-n // ANCHORS)
        left = asked.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("anchors"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
                            F.lit(1).alias("n"), F.lit(None).cast("binary").alias("ids"), F.array("label").alias("labels"), "x", "vec_id", "w", "k", "t", "hi")
        none = [F.lit(0).cast(asked.schema[c].dataType).alias(c) for c in ("vec_id", "w", "k", "t", "hi")]  # a null would turn the column to floats
        right = blocks.select("dim", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("anchors"), "slice_of", "n", "ids", "labels", "x", *none)
        right = right.withColumn("slice", F.pmod("slice_of", F.lit(slices)).cast("int")).select(*left.columns)

        def look(pdf: pd.DataFrame) -> pd.DataFrame:
            is_row = pdf["ids"].notna()
            own = pdf[~is_row].assign(label=pdf[~is_row]["labels"].str[0])
            if not len(own) or not is_row.any():
                return pd.DataFrame(columns=["anchor_id", "w", "vec_id", "score"])
            return best(own, pdf[is_row], int(pdf["dim"].iloc[0]), same)

        hits = left.unionByName(right).groupBy("dim", "anchors", "slice").applyInPandas(look, _HIT)
        ranked = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id"))
        k = asked.select(F.col("vec_id").alias("anchor_id"), "w", "k", (F.col("t") <= F.col("lo")).alias("__last"))
        hits = written(hits.withColumn("rank", ranked).where(f"rank <= {max(1, asked.agg(F.max('k')).first()[0])}").join(k, ["anchor_id", "w"]).where("rank <= k"), f"{name}-found")
        full = hits.groupBy("anchor_id", "w").agg(F.count("*").alias("__found"))
        k = k.join(full, ["anchor_id", "w"], "left").select("anchor_id", "w", (F.col("__last") | (F.coalesce("__found", F.lit(0)) >= F.col("k"))).alias("__done"))
        parts.append(hits.join(k.where("__done"), ["anchor_id", "w"], "left_semi").select("anchor_id", "w", "vec_id", "score", "rank"))
        open_ = k.where("not __done").withColumnRenamed("anchor_id", "vec_id").select("vec_id", "w")
        todo, wider = written(todo.join(open_, ["vec_id", "w"], "left_semi"), f"{name}-windows"), wider * 8
    out = parts[0] if parts else blocks.sparkSession.createDataFrame([], _HIT + ", rank int")
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(out, f"{name}-rows")


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, x (array of integers); ``anchor`` says which vec_ids are queries.  A negative's
    score is between ``low`` and ``high`` per cent of the positive's.
    """
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("x").cast("array<long>").alias("x"))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull())
    rows = rows.where(F.coalesce(valid, F.lit(False))).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("__row"))
    rows = written(rows.select("vec_id", "__row.*"), "negatives-rows")
    sample = {}
    for r in rows.select("vec_id", "x").orderBy(F.xxhash64("vec_id")).limit(SAMPLE).collect():  # SAMPLE rows at most
        sample.setdefault(len(r.x), []).append(r.x)
    sample = {n: np.array(x, float) for n, x in sample.items()}

    def pack(it):
        for pdf in it:
            for dim, own in pdf.groupby(pdf["x"].str.len()):
                x = np.array(own["x"].tolist(), np.int64).reshape(len(own), dim)
                yield pd.DataFrame({"dim": [dim], "n": [len(own)], "ids": [own["vec_id"].to_numpy().astype("<i8").tobytes()], "labels": [own["label"].tolist()], "x": [packed(x)]})

    blocks = written(rows.mapInPandas(pack, _RECORD).withColumn("slice_of", F.xxhash64("ids")), "negatives-blocks")
    pools = rows.groupBy(F.size("x").alias("__dim"), "label").agg(F.count("*").alias("pool"))
    anchors = rows.where(anchor).withColumn("__dim", F.size("x"))
    open_end = [F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi")]
    asked = anchors.join(pools, ["__dim", "label"]).select("vec_id", "label", F.lit(0).alias("w"), F.least(F.lit(positives), F.col("pool") - 1).cast("int").alias("k"), *open_end, "pool", "x")
    near = first_rows(blocks, asked.where("k > 0"), True, sample, "positives")
    # window of a positive: the integers s with low * score <= 100 * s <= high * score, in decimals as products may pass 64 bits
    score = F.col("score").cast("decimal(38,0)")
    lo = F.ceil(score * low / F.lit(100).cast("decimal(38,0)")).cast("long")
    hi = F.floor(score * high / F.lit(100).cast("decimal(38,0)")).cast("long")
    positive = near.select(F.col("anchor_id").alias("vec_id"), F.col("rank").cast("int").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), lo.alias("lo"), hi.alias("hi"))
    positive = written(positive, "positives")
    count = rows.groupBy(F.size("x").alias("__dim")).agg(F.count("*").alias("pool"))
    asked = anchors.join(count, "__dim").join(positive.where("lo <= hi"), "vec_id").select("vec_id", "label", "w", F.lit(negatives).alias("k"), "lo", "hi", "pool", "x")
    found = first_rows(blocks, asked, False, sample, "negatives")
    out = found.join(positive.withColumnRenamed("vec_id", "anchor_id").drop("lo", "hi"), ["anchor_id", "w"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: Every anchor against every row.
ORACLE = """
WITH rows AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
   AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.x, r.x)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id AND len(a.x) = len(r.x)),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score::HUGEINT <= 100 * score::HUGEINT AND 100 * score::HUGEINT <= 95 * positive_score::HUGEINT
QUALIFY rank <= 3
"""
