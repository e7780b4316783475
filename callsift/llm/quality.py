"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a whole text are counted in one pass inside the tasks.  The trees
are complete, of fixed depth, and lie in three arrays (feature, threshold, leaf), which
numpy walks for all rows at once.  They are fitted on at most ``SAMPLE`` labelled rows,
the first by a hash of the id; a group of copies weighs as many rows as it has.

Nulls: a null or empty text has zero statistics and is scored like any other; a null
doc_id is scored, but never learnt from.  A document with several labels counts as its
lowest.  Without labels every score is 0.5.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, prepare, text_bytes

SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, PENALTY = 64, 4, 80, 0.15, 2.0

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "other_byte", "mark", "stop", "exclaim", "pipe", "symbol",
            "symbol_end", "bare_symbol", "distinct", "top_word", "log_lines", "line_words", "short_lines", "repeated_lines",
            "longest_word", "entropy", "worst_symbol_line", "worst_upper_line")
_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b",;:'\"()-", b".?", b"!", b"|", b"#$%&*@^~<>{}[]\\/=+_`")):
    _CLASS[list(_bytes)] = _k + 1
_SYMBOLS = b"#$%&*@^~<>{}[]\\/=+_`!|"


def statistics(text: bytes) -> list[float]:
    """The numbers of ``FEATURES`` for one text."""
    words, lines = text.split(), text.split(b"\n")
    n, w = max(len(text), 1), max(len(words), 1)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, counts, 9)
    share = counts[counts > 0] / n
    each, in_line = Counter(words), Counter(lines)
    odd = sum(c for x, c in each.items() if x[-1] in _SYMBOLS)
    bare = sum(c for x, c in each.items() if not x.strip(_SYMBOLS))
    long_lines = [x for x in in_line if len(x) > 40]
    worst_symbol = max((sum(map(x.count, (b"|", b"#", b"$", b"%", b"&", b"*", b"!"))) / len(x) for x in long_lines), default=0.0)
    worst_upper = max((1.0 for x in long_lines if x.isupper()), default=0.0)
    return [math.log1p(len(text)), math.log1p(len(words)), len(text) / w, *(kinds[1:9] / n), odd / w, bare / w, len(each) / w,
            max(each.values(), default=0) / w, math.log1p(len(lines)), len(words) / len(lines),
            sum(c for x, c in in_line.items() if len(x) < 20) / len(lines), 1 - len(in_line) / len(lines),
            max(map(len, each), default=0), float(-(share * np.log2(share)).sum()), worst_symbol, worst_upper]


class Trees:
    """Complete trees in flat arrays: inner node i of a tree has the children 2i+1 and 2i+2."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.bias, self.feature, self.threshold, self.leaf = bias, feature, threshold, leaf

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows, inner = np.full(len(x), self.bias), np.arange(len(x)), self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boosted trees of log loss with second-order leaf values."""
    inner, features = 2 ** DEPTH - 1, x.shape[1]
    p = (y.sum() + 1) / (len(y) + 2)
    out = Trees(math.log(p / (1 - p)), np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not len(y):
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(features)]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # x > edge[b] means bin > b
    raw = np.full(len(y), out.bias)
    for k in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2 ** depth - 1, 2 ** depth
            at = node - first
            best = np.full(width, 1e-6)
            for j in range(features):
                key = at * BINS + bins[j]
                gl = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(1)
                hl = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + PENALTY) + (gt - gl) ** 2 / (ht - hl + PENALTY) - gt ** 2 / (ht + PENALTY)
                gain = gain[:, :len(edges[j])]
                if gain.shape[1]:
                    b = gain.argmax(1)
                    value = gain[np.arange(width), b]
                    for i in np.flatnonzero(value > best):
                        best[i], out.feature[k, first + i], out.threshold[k, first + i] = value[i], j, edges[j][b[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), out.feature[k, node]] > out.threshold[k, node])
        gs, hs = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        out.leaf[k] = -RATE * gs / (hs + PENALTY)
        raw += out.leaf[k][node - inner]
    return out


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` labelled rows that are not held out."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"), mod))
             .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def measure(it):
        for b in it:
            x = [statistics(t) for t in text_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1).cast(pa.int32())], names=["x", "y"])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("quality").cast("int").alias("quality"))
    rows = rows.mapInArrow(measure, "x array<double>, y int").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    y = (rows["y"].to_numpy() > 0).astype(float)
    order = np.lexsort([*x.T, y])  # the same model whatever the order of the rows
    return fit(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, mod: int = 4, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    model = train(docs, labels, mod)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def score(it):
        for b in it:
            x = np.array([statistics(t) for t in text_bytes(b.column(2))], float).reshape(-1, len(FEATURES))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), mod).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    prepare(docs.sparkSession)
    model = train(docs, labels)
    text = docs.columns.index("text")

    def keep(it):
        for b in it:
            x = np.array([statistics(t) for t in text_bytes(b.column(text))], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
