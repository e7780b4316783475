"""Hard negatives against all pairs in Python integers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callsift.llm import hard_negatives as H
from callsift.llm.queries import op12_hard_negatives


def brute(rows, every=5, positives=5, negatives=3):
    kept = {}
    for i, label, x in rows:
        if i is not None and label is not None and x and None not in x:
            kept[i] = min(kept.get(i, (str(label), x)), (str(label), x))
    out = []
    for a in kept:
        if a % every:
            continue
        label, q = kept[a]
        scored = sorted((-sum(m * n for m, n in zip(q, x)), i, y == label) for i, (y, x) in kept.items() if i != a and len(x) == len(q))
        for p, positive, _ in [s for s in scored if s[2]][:positives]:
            fit = [(i, -s) for s, i, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(a, positive, k + 1, i, -p, s) for k, (i, s) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every=5):
    df = spark.createDataFrame([(i, label, x, "e") for i, label, x in rows], "vec_id long, label int, x array<long>, score string").repartition(3)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % every == 0).collect()))


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(12)
    centre = rnd.normal(size=(4, 24)) * 60
    x = rnd.normal(size=(420, 24)) * 40 + centre[rnd.integers(0, 4, 420)]
    x[:140] = centre[0] + rnd.normal(size=(140, 24)) * 2  # a hot group of near copies over all labels
    x[140:150] = centre[1]  # equal vectors: ties
    out = [(i, int(rnd.integers(0, 3)), np.floor(v).astype(int).tolist()) for i, v in enumerate(x)]
    out += [out[5], out[10], (15, 2, out[3][2]), (None, 1, out[1][2]), (1000, None, out[1][2]), (1005, 1, None), (1010, 1, [1, None]), (1015, 1, []),
            (1020, 1, [3, 4]), (1021, 1, [5, 5]), (1022, 2, [4, 3]), (1025, 9, [0] * 24), (1030, 7, out[0][2]), (-5, 0, out[7][2])]
    return out


def test_hard_negatives_equal_brute_force(spark, rows):
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 500


def test_small_blocks_and_a_useless_sample(spark, rows, monkeypatch):
    """Many groups, and first thresholds far too high: the rounds lower them until every window is full."""
    monkeypatch.setattr(H, "ANCHORS", 20)
    monkeypatch.setattr(H, "BLOCKS", 1)
    monkeypatch.setattr(H, "threshold", lambda s, k, lo, hi, pool, wider, t=H.threshold: [
        b if wider < 8 else max(a, min(b, c)) for a, b, c in zip(lo, hi, t(s + 1e4, k, lo, hi, pool, wider / 8))])
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_scores_beyond_doubles(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, i % 2, [int(v) for v in rnd.integers(-(1 << 29), 1 << 29, 8)]) for i in range(60)]
    assert mined(spark, rows) == brute(rows)
    with pytest.raises(OverflowError):
        H.exact_scores(np.full((1, 4), 1 << 40), np.full((1, 4), 1 << 40))


def test_no_rows(spark, rows):
    assert mined(spark, [r for r in rows if r[0] is not None and r[0] % 5]) == []
    empty = spark.createDataFrame([], "vec_id long, label int, x array<long>")
    assert H.hard_negatives(empty, F.col("vec_id") % 5 == 0).count() == 0


def test_index_loses_no_pair():
    rnd = np.random.default_rng(4)
    for scale in (1, 30, 3000):
        x = np.floor(rnd.normal(size=(300, 40)) * scale * rnd.exponential(size=40)).astype(np.int64)
        q = x[::7] + rnd.integers(-2, 3, (43, 40))
        s = q @ x.T
        for share in (0.5, 0.99, 0.9999):
            t = np.quantile(s, share, axis=1).astype(np.int64)
            a, r, got = H.reaching(q, t, x)
            assert sorted(zip(a.tolist(), r.tolist())) == sorted(zip(*(v.tolist() for v in np.nonzero(s >= t[:, None]))))
            assert (got == s[a, r]).all()


def test_lists_omit_dimensions_under_the_suffix_bound():
    x = np.array([[100, 1, 0, 0], [0, 3, 2, 1], [1, 1, 1, 1]])
    lists = H.Lists(x, longest=10.0, lowest=500.0)
    assert lists.count.tolist() == [1, 0, 0, 0] and lists.cut.tolist() == [1, 0, 0]


def test_query_reads_labels_and_floors(spark, tmp_path):
    pd.DataFrame({"vec_id": [0, 1, 2, 7, 50], "embedding": [[1.0, 0.0], [0.9, 0.1], [0.8, -0.001], [0.7, 0.0], [float("nan"), 1.0]], "label": [3, 4, 3, 3, 3]}).to_parquet(tmp_path / "embeddings.parquet")
    # label of 0 becomes 4, of 7 becomes 4
    assert sorted(map(tuple, op12_hard_negatives(spark, str(tmp_path)).collect())) == [(0, 1, 1, 2, 58880, 52224)]
