"""Prediction by partial matching over bytes, trained on word counts and sharded by context.

The model is a trie of byte contexts over the words of a text, each followed by a
space; a space at a word's place ends the document.  A context is the ``ORDER``
bytes before a symbol, but reaches back at most ``REACH`` bytes into the word before
(spaces fill the rest).  A symbol is looked for in its longest context first; where
it was not seen there, the escape of method D is paid (half a count for each distinct
symbol) and the next shorter context is tried, without the symbols that the longer
one holds (symbol exclusion).  Below order 0 the rest of the alphabet is uniform.

How it is spread:

* documents -> blocks of about ``BLOCK_BYTES``: the distinct words of a block, its
  distinct heads (two bytes of the word before and the first four of a word, all that
  can share a context with it), and each document as numbers of both (one pass over
  the text);
* counts of words and heads over all blocks, then of (context, symbol) over distinct ones;
* contexts that share their last two bytes lie in one shard, which holds the whole
  chain from order 5 to 2; orders 1 and 0 have at most 256 * 256 pairs in all and
  go to every shard;
* a code length per distinct (context, symbol), a sum per distinct word and head, and
  back to the blocks, where the documents add them up.

Nulls: a null text is empty (one token, the end); a null doc_id is kept and trained
on unless its empty text has remainder 2.  Repeated rows each count and each score.
An empty table gives no rows; without training rows every symbol is uniform.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, fresh_id, group_sums, held_out, planes, prepare, unplanes, written

ORDER = 5
#: Bytes of the word before that a context can hold.
REACH = 2
#: First symbols of a word whose context can hold bytes of the word before.
HEAD = ORDER - 1
#: Bytes of a word's symbols: 256 less the six white-space bytes, and the end of a word.
ALPHABET = 251
BLOCK_BYTES = 40 << 20
#: Tokens whose heads are numbered at a time, to bound the memory of a block.
STEP = 1 << 20
SHARDS = 512
#: Rows (16 bytes each) up to which the table of code lengths is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 4_000_000

_INDEX = "kind int, block long, doc_id long, held boolean, ids binary, ends binary, fronts binary, unit binary, at int, c long"
_INDEX_ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()), ("ids", pa.binary()),
                          ("ends", pa.binary()), ("fronts", pa.binary()), ("unit", pa.binary()), ("at", pa.int32()), ("c", pa.int64())])
#: Rows of the index: a document, a block (how each of its words ends and begins), a unit of a block.
DOCS, BLOCKS, UNITS = 0, 1, 2


def word_split(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case."""
    return text.lower().split()


def head_pairs(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, fronts: np.ndarray) -> Iterator[np.ndarray]:
    """For each token, a number for the end of the word before and the front of its own; a part of the tokens at a time."""
    first = np.zeros(len(flat), bool)
    first[starts] = True
    width = int(fronts.max()) + 1
    for i in range(0, len(flat), STEP):
        part = flat[i:i + STEP]
        before = np.empty(len(part), np.int64)
        before[1:] = ends[part[:-1]]
        before[0] = ends[flat[i - 1]] if i else 0
        before[first[i:i + STEP]] = ends[0]  # a document starts as after an end
        yield before * width + fronts[part]


class _Block:
    """Documents as numbers of the block's distinct words; number 0 is the end of a document."""

    def __init__(self):
        self.name = fresh_id()
        self.number = defaultdict(itertools.count().__next__)
        self.number[b""]
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id, held, text: bytes) -> None:
        words = word_split(text)
        ids = np.empty(len(words) + 1, np.int32)
        ids[:-1] = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        ids[-1] = 0
        self.docs.append((doc_id, held, ids))
        self.size += len(text)

    def rows(self) -> Iterator[pa.RecordBatch]:
        words, ids = list(self.number), [d[2] for d in self.docs]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, starts = np.concatenate(ids), np.cumsum(size) - size
        learnt = np.repeat(np.array([not d[1] for d in self.docs]), size)
        end, front = defaultdict(itertools.count().__next__), defaultdict(itertools.count().__next__)
        ends = np.fromiter((end[(b"  " + w)[-REACH:]] for w in words), np.int64, len(words))
        fronts = np.fromiter((front[(w + b" ")[:HEAD]] for w in words), np.int64, len(words))
        pairs = np.unique(np.concatenate([np.unique(p) for p in head_pairs(flat, starts, ends, fronts)]))
        seen = np.zeros(len(pairs), np.int64)
        for i, p in enumerate(head_pairs(flat, starts, ends, fronts)):
            seen += np.bincount(np.searchsorted(pairs, p)[learnt[i * STEP:(i + 1) * STEP]], minlength=len(pairs))
        name = {"kind": DOCS, "block": self.name}
        yield from self.batch(name | {"doc_id": [d[0] for d in self.docs], "held": [d[1] for d in self.docs],
                                      "ids": [planes(x) for x in ids]}, len(ids))
        yield from self.batch(name | {"kind": BLOCKS, "ends": [planes(ends)], "fronts": [planes(fronts)]}, 1)
        yield from self.batch(name | {"kind": UNITS, "unit": words, "at": np.arange(len(words), dtype=np.int32),
                                      "c": np.bincount(flat[learnt], minlength=len(words))}, len(words))
        ends_, fronts_, pad, width = list(end), list(front), b" " * (ORDER - REACH - 1), int(fronts.max()) + 1
        heads = [pad + ends_[p // width] + b" " + fronts_[p % width] for p in pairs.tolist()]
        yield from self.batch(name | {"kind": UNITS, "unit": heads, "at": np.arange(len(heads), dtype=np.int32) + len(words), "c": seen}, len(heads))

    @staticmethod
    def batch(columns: dict, n: int) -> Iterator[pa.RecordBatch]:
        full = lambda x: [x] * n if x is None or isinstance(x, int) else x
        yield from batches(_INDEX_ARROW, {f.name: full(columns.get(f.name)) for f in _INDEX_ARROW}, 10_000)


def _index(it):
    block = _Block()
    for b in it:
        for doc_id, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
            block.add(doc_id, held, text or b"")
            if block.size >= BLOCK_BYTES:
                yield from block.rows()
                block = _Block()
    if block.docs:
        yield from block.rows()


def grams(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) as one number of 6 bytes for each symbol after a unit's first ``ORDER`` bytes; each unit's count of symbols."""
    buf = np.frombuffer(b"".join(units) + b" " * ORDER, np.uint8)
    full = np.fromiter(map(len, units), np.int64, len(units))
    size = np.maximum(full - ORDER, 0)
    n = len(buf) - ORDER
    g = np.zeros(n, np.int64)
    for j in range(ORDER + 1):
        g = (g << 8) | buf[j:j + n]
    start = np.cumsum(full) - full
    where = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return g[where], size


def _units(units: list[bytes]) -> list[bytes]:
    """Heads, which begin with a space, are units as they stand; of a word, the symbols after its head are left."""
    return [u if u[:1] == b" " else b" " + u + b" " for u in units]


_GRAM = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
_UNIT_GRAM = pa.schema([("unit", pa.binary()), ("c", pa.int64()), ("gram", pa.int64())])


def _count_grams(it):
    for b in it:
        g, size = grams(_units(b.column(0).to_pylist()))
        u, at = np.unique(g, return_inverse=True)
        yield from batches(_GRAM, {"gram": u, "n": np.bincount(at, np.repeat(b.column(1).to_numpy(), size)).astype(np.int64)})


def _unit_grams(it):
    for b in it:
        g, size = grams(_units(b.column(0).to_pylist()))
        one = np.maximum(size, 1)  # a word without symbols after its head has one row without a gram
        first = np.cumsum(one) - one
        at = pa.array(np.repeat(np.arange(b.num_rows), one))
        code = np.zeros(len(at), np.int64)
        none = np.zeros(len(at), bool)
        none[first[size == 0]] = True
        code[~none] = g
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(code, mask=none)], schema=_UNIT_GRAM)


class _Level:
    """Counts of one order: sorted (context, symbol) pairs, and each context's total and distinct symbols."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        self.pairs, at = np.unique(pairs, return_inverse=True)
        self.n = np.bincount(at, n, len(self.pairs)).astype(np.float64)
        self.ctx, self.first, self.distinct = np.unique(self.pairs >> 8, return_index=True, return_counts=True)
        self.total = group_sums(self.n, self.first)

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
        return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def code_lengths(gram: np.ndarray, n: np.ndarray, low: np.ndarray, low_n: np.ndarray) -> np.ndarray:
    """log10 probability of each (context, symbol); ``low``: pairs of order 1 over the whole corpus."""
    seen = n > 0
    levels = {}
    for k in range(ORDER, 1, -1):
        levels[k] = _Level(gram[seen] & ((1 << 8 * (k + 1)) - 1), n[seen])
    levels[1] = _Level(low[low_n > 0], low_n[low_n > 0])
    levels[0] = _Level(levels[1].pairs & 255, levels[1].n)
    out, active = np.zeros(len(gram)), np.ones(len(gram), bool)
    less_n, less_d = np.zeros(len(gram)), np.zeros(len(gram))
    for k in range(ORDER, -1, -1):
        lv = levels[k]
        pair = gram & ((1 << 8 * (k + 1)) - 1)
        at, has = lv.find(lv.ctx, pair >> 8)
        if not has.any():
            continue
        total, distinct = lv.total[at] - less_n, lv.distinct[at] - less_d
        where, found = lv.find(lv.pairs, pair)
        hit, miss = active & has & found, active & has & ~found & (distinct > 0)
        out[hit] += np.log10((lv.n[where[hit]] - 0.5) / total[hit])
        out[miss] += np.log10(0.5 * distinct[miss] / total[miss])
        active &= ~hit
        if k:  # what this context holds no longer counts in the next shorter one
            up = levels[k - 1]
            own, _ = up.find(up.pairs, lv.pairs & ((1 << 8 * k) - 1))
            held = group_sums(up.n[own], lv.first)
            less_n, less_d = np.where(has, held[at], 0), np.where(has, lv.distinct[at], 0)
    out[active] -= np.log10(max(1, ALPHABET - len(levels[0].pairs)))
    return out


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])


def _sum_units(docs: pa.Table, known: pa.Table, n: int, v: int) -> pa.Table:
    order = np.argsort(known["at"].to_numpy())
    lp, c = known["lp"].to_numpy()[order].astype(np.float64), known["c"].to_numpy()[order]
    block, docs = docs.filter(pc.equal(docs["kind"], BLOCKS)), docs.filter(pc.equal(docs["kind"], DOCS))
    ends, fronts = (unplanes(block[x][0].as_py()).astype(np.int64) for x in ("ends", "fronts"))
    ids = [unplanes(x).astype(np.int32) for x in docs["ids"].to_pylist()]
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat, starts = np.concatenate(ids), np.cumsum(size) - size
    del ids
    pairs = np.unique(np.concatenate([np.unique(p) for p in head_pairs(flat, starts, ends, fronts)]))
    symbols = lp[flat]
    for i, p in enumerate(head_pairs(flat, starts, ends, fronts)):
        symbols[i * STEP:(i + 1) * STEP] += lp[len(ends) + np.searchsorted(pairs, p)]
    known_, base = (c > 0).astype(np.int64), np.log10((c + 1) / (n + v + 1))
    return pa.table([docs["doc_id"], docs["held"], pa.array(size), pa.array(group_sums(known_[flat], starts)),
                     pa.array(group_sums(base[flat], starts)), pa.array(group_sums(symbols, starts))], schema=_SCORED)


def ppm_scores(docs: DataFrame, mod: int = 7) -> DataFrame:
    """Score every text of ``docs`` (doc_id, text); learn from rows that are not held out."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", held_out(F.col("doc_id"), mod).alias("held"), "text")
    index = written(rows.mapInArrow(_index, _INDEX), "ppm-index", "kind")
    vocab = index.where(F.col("kind") == UNITS).select("block", "at", "unit", "c")
    units = written(vocab.groupBy("unit").agg(F.sum("c").alias("c")), "ppm-units")
    is_word = ~F.substring("unit", 1, 1).eqNullSafe(F.lit(b" "))
    n, v = units.where(is_word).agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    counts = units.mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "ppm-grams")
    pair = F.col("gram").bitwiseAND(0xFFFF)
    low = counts.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).toPandas()  # at most 65,536 pairs
    low_pairs, low_n = low["pair"].to_numpy(np.int64), low["n"].to_numpy(np.int64)

    def code(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"gram": pdf["gram"], "lp": code_lengths(pdf["gram"].to_numpy(), pdf["n"].to_numpy(), low_pairs, low_n)})

    shard = F.pmod(F.hash(F.shiftright("gram", 8).bitwiseAND(0xFFFF)), F.lit(SHARDS))
    codes = written(counts.groupBy(shard).applyInPandas(code, "gram long, lp double"), "ppm-codes")
    side = F.broadcast(codes) if codes.count() <= BROADCAST_ROWS else codes
    scored = (units.mapInArrow(_unit_grams, "unit binary, c long, gram long").join(side, "gram", "left")
              .groupBy("unit").agg(F.first("c").alias("c"), F.coalesce(F.sum("lp"), F.lit(0.0)).cast("float").alias("lp")))
    known = vocab.select("block", "at", "unit").join(scored, "unit").select(F.col("block").alias("of"), "at", "c", "lp")
    texts = index.where(F.col("kind") != UNITS).select("kind", "block", "doc_id", "held", "ids", "ends", "fronts")

    def total(docs: pa.Table, known: pa.Table) -> pa.Table:
        return _sum_units(docs, known, n, v)

    out = (texts.groupBy("block").cogroup(known.groupBy("of"))
           .applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
