"""Re-Pair compressed id files: grammar per shard, with expansion lengths for random access.

A file is Parquet; a row is a shard of about ``SHARD_IDS`` ids, whole documents in
ascending doc_id order.  Encoding repeats rounds: count the adjacent pairs within
documents, give the most frequent ones a nonterminal each, and replace them from left
to right.  A rule's sides are ids or earlier nonterminals.  A shard stores its rules,
the expansion length of each, the symbols, and each document's first symbol and first id;
any range of a document's ids is decoded from its own symbols alone.

Nulls: a null text is empty (its end id alone), a null doc_id sorts first.  Repeated rows
are kept, each with its place.  An empty table gives a file without shards.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, text_bytes, written
from .wordids import default_path, word_ids

SHARD_IDS = 1 << 20
ROUNDS = 6
#: New rules of a round, and the uses that a pair needs.
RULES, LEAST = 1024, 16
#: Pairs are counted by a hash first; one pair of each full bucket is then counted exactly.
BUCKETS = 1 << 18

SHARD_DDL = ("part int, shard int, n_docs int, n_ids long, first int, rules binary, lengths binary, symbols binary,"
             " doc_ids binary, no_id binary, doc_symbols binary, doc_starts binary")
_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("first", pa.int32()),
                    ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("doc_ids", pa.binary()),
                    ("no_id", pa.binary()), ("doc_symbols", pa.binary()), ("doc_starts", pa.binary())])


def compress(ids: np.ndarray, starts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), symbols, and each document's first symbol; ``first``: the first nonterminal."""
    seq, starts, rules = ids.astype(np.int64), starts.astype(np.int64), []
    for turn in range(ROUNDS):
        if len(seq) < 2:
            break
        key = (seq[:-1] << 32) | seq[1:]
        bucket = ((key * (0x9E3779B97F4A7C1 + 2 * turn)) >> 24) & (BUCKETS - 1)
        bucket[starts[1:] - 1] = BUCKETS  # a pair lies in one document
        full = np.bincount(bucket, minlength=BUCKETS + 1)
        full[BUCKETS] = 0
        least = max(LEAST, int(np.partition(full, -RULES)[-RULES]))
        hot = np.flatnonzero((full >= least)[bucket])
        bucket, key = bucket[hot], key[hot]
        pair_of = np.zeros(BUCKETS, np.int64)
        pair_of[bucket] = key  # one pair for each full bucket; a pair that loses its bucket has another in the next round
        same = key == pair_of[bucket]
        place, bucket = hot[same], bucket[same]
        count = np.bincount(bucket, minlength=BUCKETS)
        chosen = np.flatnonzero(count >= LEAST)
        chosen = chosen[np.argsort(-count[chosen], kind="stable")][:RULES]
        if not len(chosen):
            break
        pairs, number_of = pair_of[chosen], np.full(BUCKETS, -1, np.int64)
        number_of[chosen] = np.arange(len(chosen))
        number = number_of[bucket]
        place, number = place[number >= 0], number[number >= 0]
        run = np.flatnonzero(np.diff(place, prepend=-2) > 1)  # pairs that overlap form a run: every other one is replaced
        use = (np.arange(len(place)) - np.repeat(run, np.diff(run, append=len(place)))) % 2 == 0
        place, number = place[use], number[use]
        seq[place] = first + len(rules) + number
        keep = np.ones(len(seq), bool)
        keep[place + 1] = False
        starts = (np.cumsum(keep) - 1)[starts]
        seq = seq[keep]
        rules += [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in pairs]
    return np.array(rules, "<u4").reshape(-1, 2), seq.astype("<u4"), starts


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    n = np.ones(len(rules), np.int64)
    of = lambda s: n[s - first] if s >= first else 1
    for i, (a, b) in enumerate(rules.tolist()):
        n[i] = of(a) + of(b)
    return n


class Expander(dict):
    """Symbol -> ids (little-endian, 32 bits each)."""

    def __init__(self, rules: np.ndarray, first: int):
        super().__init__()
        for i, (a, b) in enumerate(rules.tolist()):
            self[first + i] = self[a] + self[b]

    def __missing__(self, symbol: int) -> bytes:
        self[symbol] = symbol.to_bytes(4, "little")
        return self[symbol]


def ids_between(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to ``hi`` (not included) of a document from its symbols; only the symbols that cover them are expanded."""
    own = np.ones(len(symbols), np.int64)
    big = symbols >= first
    own[big] = lengths[symbols[big].astype(np.int64) - first]
    ends = np.cumsum(own)
    a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left")
    data = b"".join(map(Expander(rules, first).__getitem__, symbols[a:b + 1].tolist()))
    skip = lo - int(ends[a] - own[a]) if len(ends) > a else 0
    return np.frombuffer(data, "<u4")[skip:skip + hi - lo]


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) as shards in ascending doc_id order; the shards as read back."""
    prepare(docs.sparkSession)
    path = path or default_path()

    def encode(it):
        enc, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        part, shard, held, size = TaskContext.get().partitionId(), 0, [], 0

        def full():
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            n = np.fromiter((len(x) // 4 for _, x in held), np.int64, len(held))
            starts = np.cumsum(n) - n
            rules, symbols, at = compress(ids, starts, enc.size)
            key = np.array([d or 0 for d, _ in held], "<i8")
            none = np.packbits([d is None for d, _ in held])
            row = (part, shard, len(held), len(ids), enc.size, rules.tobytes(), expansion_lengths(rules, enc.size).astype("<i8").tobytes(),
                   symbols.tobytes(), key.tobytes(), none.tobytes(), at.astype("<i8").tobytes(), starts.astype("<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _SHARD)], schema=_SHARD)

        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                held.append((doc_id, enc.encode(text) + end))
                size += len(held[-1][1]) // 4
                if size >= SHARD_IDS:
                    yield full()
                    shard, held, size = shard + 1, [], 0
        if held:
            yield full()

    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(rows.mapInArrow(encode, SHARD_DDL), "repair-shards")


_READ = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def expanded(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all symbols, and where each symbol's ids begin."""
    expand = Expander(rules, first)
    table = np.frombuffer(b"".join(expand[first + i] for i in range(len(rules))), "<u4")
    at_rule = np.cumsum(lengths) - lengths
    rule = symbols >= first
    which = symbols[rule].astype(np.int64) - first
    own = np.ones(len(symbols), np.int64)
    own[rule] = lengths[which]
    begin = np.cumsum(own) - own
    ids = np.repeat(symbols, own)
    n = own[rule]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    ids[inside + np.repeat(begin[rule], n)] = table[inside + np.repeat(at_rule[which], n)]
    return ids, begin


def _decode(it):
    for b in it:
        for s in b.to_pylist():
            rules, symbols = np.frombuffer(s["rules"], "<u4").reshape(-1, 2), np.frombuffer(s["symbols"], "<u4")
            ids, begin = expanded(symbols, rules, np.frombuffer(s["lengths"], "<i8"), s["first"])
            k, data = s["n_docs"], memoryview(ids.tobytes())
            ends = np.append(begin[np.frombuffer(s["doc_symbols"], "<i8")], len(ids))
            crc = [zlib.crc32(data[4 * a:4 * e]) for a, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
            doc_ids = pa.array(np.frombuffer(s["doc_ids"], "<i8"), pa.int64(), mask=np.unpackbits(np.frombuffer(s["no_id"], np.uint8), count=k).astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array([s["part"]] * k, pa.int32()), pa.array([s["shard"]] * k, pa.int32()), doc_ids,
                                              pa.array(np.frombuffer(s["doc_starts"], "<i8"), pa.int64()), pa.array(np.diff(ends), pa.int64()),
                                              pa.array(crc, pa.int64())], schema=_READ)


def read_ids(shards: DataFrame) -> DataFrame:
    """Decode shards: per document its first id's place in the whole, its count of ids and their crc32."""
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row per written file
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    own = shards.select("part", "shard", "n_ids").join(before, "part")
    own = own.select("part", "shard", (F.col("before") + F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("before"))
    got = shards.mapInArrow(_decode, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return got.join(own, ["part", "shard"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
