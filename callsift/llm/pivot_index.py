"""Near-duplicate vectors by a pivot-permutation index, verified by cosine in double precision.

The pivots are a bounded sample of the vectors, thinned: of two within twice the threshold's
angle one stays, so a dense group owns few pivots however large it is.  Two kinds of lists:

1. A vector within that angle of its nearest pivot has it as its home.  The list of a pivot
   holds the vectors within (its farthest home vector + the threshold's angle); by the
   triangle inequality every linked partner of a home vector is there.  Pairs are looked at in the
   smaller of their homes.  This is exact, and covers every group that the sample has met.
2. Vectors without a home are far from all of the sample.  Each stands in the lists of its
   ``NEAREST`` nearest pivots; two are candidates if they share at least ``SHARED`` (or all, if there
   are fewer pivots), and are looked at in the list of their smallest shared pivot.

Lists are kept within a label.  A long list is cut into parts of about ``PART`` vectors, and each pair of
parts is a group of its own, so no list lies in one task; a group returns counts of links
and a spanning forest, never the pairs.  Equal vectors of one label are one row with a weight.

Nulls: vectors that are null, empty, zero or hold null or non-finite components, and rows
without a label, link with nothing and are their own component.  Vectors of different
lengths are not compared.  Repeated rows are equal vectors.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .components import components

#: Pivots: twice the square root of the rows, within these bounds.
FEWEST, MOST = 32, 2048
NEAREST, SHARED = 10, 2
PART = 1200
#: The home of a vector without one; what the rounding of angles may come to.
NO_HOME, SLACK = (1 << 31) - 1, 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (i, smallest node of its component) for the linked of n nodes."""
    low = np.arange(n)
    while True:
        m = low.copy()
        np.minimum.at(m, a, low[b])
        np.minimum.at(m, b, low[a])
        m = m[m]
        if (m == low).all():
            break
        low = m
    i = np.flatnonzero(low != np.arange(n))
    return list(zip(i.tolist(), low[i].tolist()))


def thinned(p: np.ndarray, most: float) -> np.ndarray:
    """The rows of ``p`` in order, without those whose cosine with an earlier kept one is above ``most``."""
    free, kept = np.ones(len(p), bool), []
    for i in range(len(p)):
        if free[i]:
            kept.append(i)
            free &= p @ p[i] <= most
    return p[kept]


def angles(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ p.T, -1, 1))


def link_counts(x: np.ndarray, home: np.ndarray, near: np.ndarray | None, weight: np.ndarray, side: np.ndarray, pivot: int, shared: int, threshold: float) -> tuple[np.ndarray, list]:
    """Weighted links of each vector and a forest of them, over the pairs that belong to the list of ``pivot``.

    near None: pairs whose smaller home is the pivot; else pairs whose smallest shared pivot it is.
    side 0: within one part; sides 1 and 2: pairs between two parts only.
    """
    if near is not None:
        names, at = np.unique(near, return_inverse=True)
        has = np.zeros((len(x), len(names)), np.float32)
        has[np.arange(len(x))[:, None], at.reshape(near.shape)] = 1
        below = has[:, :np.searchsorted(names, pivot)]
    left, right = (np.flatnonzero(side == s) for s in (1, 2)) if side.any() else (np.arange(len(x)), np.arange(len(x)))
    links, edges = np.zeros(len(x), np.int64), ([], [])
    for i in range(0, len(left), 256):
        l = left[i:i + 256]
        ok = x[l] @ x[right].T >= threshold
        if near is None:
            ok &= np.minimum(home[l][:, None], home[right][None, :]) == pivot
        else:
            ok &= (has[l] @ has[right].T >= shared) & (below[l] @ below[right].T == 0)
        ok &= l[:, None] != right[None, :]
        links[l] += ok @ weight[right]
        if side.any():
            links[right] += weight[l] @ ok
        p, q = np.nonzero(ok)
        edges[0].append(l[p])
        edges[1].append(right[q])
    return links, forest(len(x), np.concatenate(edges[0]), np.concatenate(edges[1])) if len(left) else []


def near_duplicates(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows`` (vec_id, embedding, label)."""
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"), "label")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", finite) & F.exists("x", lambda v: v != 0)
    rows = written(rows.select("vec_id", "label", F.when(F.coalesce(valid, F.lit(False)), F.transform("x", lambda v: v + F.lit(0.0))).alias("x")), "pivot-rows")
    one = written(rows.where("x is not null").groupBy("label", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "pivot-vectors")
    count = one.count()
    take = int(min(MOST, max(FEWEST, 2 * count ** 0.5)))
    sample = one.select("id", "x").orderBy(F.xxhash64("id")).limit(take).toPandas()["x"]  # at most MOST vectors
    reach = float(np.arccos(threshold))
    most = float(np.cos(min(np.pi, 2 * reach)))  # a home is at most so far
    pivots = {n: thinned(unit(np.array([v for v in sample if len(v) == n])), most) for n in {len(v) for v in sample}}

    def placed(pdf: pd.DataFrame):
        """Rows of one length each, their angles to the pivots and their homes (NO_HOME for none)."""
        for n, own in pdf.groupby(pdf["x"].str.len()):
            far = angles(unit(np.array(own["x"].tolist())), pivots.get(n, np.ones((1, n)) / n ** 0.5))
            best = far.argmin(1)
            yield n, own, far, np.where(far[np.arange(len(own)), best] <= 2 * reach + SLACK, best, NO_HOME)

    def widths(it):
        for pdf in it:
            for n, own, far, home in placed(pdf):
                some = np.flatnonzero(home != NO_HOME)
                yield pd.DataFrame({"dim": n, "home": home[some], "width": far[some, home[some]]}).groupby(["dim", "home"], as_index=False).max()

    width = {}
    for r in one.select("x").mapInPandas(widths, "dim int, home int, width double").groupBy("dim", "home").agg(F.max("width").alias("width")).collect():
        width.setdefault(r.dim, {})[r.home] = r.width  # a number per pivot

    def describe(it):
        for pdf in it:
            for n, own, far, home in placed(pdf):
                wide = np.full(far.shape[1], -1.0)  # no home vectors, no list
                for h, w in width.get(n, {}).items():
                    wide[h] = w + reach + SLACK
                # a partner with a smaller home looks at the pair there
                inside = (far <= wide) & (np.arange(far.shape[1]) <= home[:, None])
                near = np.argsort(far, axis=1, kind="stable")[:, :NEAREST].astype(np.int32)
                yield own.assign(home=home.astype(np.int32), lists=[np.flatnonzero(r).astype(np.int32) for r in inside],
                                 near=[r if h == NO_HOME else r[:0] for r, h in zip(near, home)])

    described = one.select("label", "id", "weight", "x").mapInPandas(describe, f"label {one.schema['label'].dataType.simpleString()}, id long, weight long, x array<double>, home int, lists array<int>, near array<int>")
    described = written(described, "pivot-described")
    # -1 - pivot names the list of the vectors without a home
    both = F.explode(F.concat("lists", F.transform("near", lambda p: -1 - p))).alias("pivot")
    entry = described.select("label", F.size("x").alias("dim"), both, "id", "weight", "x", "home", "near")
    parts = (described.select("label", F.size("x").alias("dim"), both, "home").groupBy("label", "dim", "pivot")
             .agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("n"), F.min("home").alias("low"))
             .where("n > 1 and (pivot < 0 or low = pivot)").drop("n", "low"))
    entry = entry.join(parts, ["label", "dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # part p meets itself and every other part: one row for each meeting
    entry = entry.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    lo, hi = F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side")
    entry = entry.select("label", "dim", "pivot", lo, hi, side, "id", "weight", "x", "home", "near")

    def look(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        pdf = pdf.iloc[np.argsort(ids, kind="stable")]
        ids, pivot = pdf["id"].to_numpy(), int(pdf["pivot"].iloc[0])
        near = np.array(pdf["near"].tolist()) if pivot < 0 else None
        links, tree = link_counts(unit(np.array(pdf["x"].tolist())), pdf["home"].to_numpy(), near, pdf["weight"].to_numpy(), pdf["side"].to_numpy(),
                                  -1 - pivot if pivot < 0 else pivot, min(SHARED, near.shape[1]) if pivot < 0 else 0, threshold)
        some = np.flatnonzero(links)
        root = dict(tree)
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": [ids[root.get(i, i)] for i in some.tolist()]})

    found = written(entry.groupBy("label", "dim", "pivot", "lo", "hi").applyInPandas(look, "id long, links long, root long"), "pivot-links")
    roots = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = (one.join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
             .select("label", "x", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("root")))
    valid = rows.where("x is not null").join(known, ["label", "x"]).select("vec_id", "n_links", F.col("root").alias("component_id"))
    lone = rows.where("x is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return valid.unionByName(lone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
