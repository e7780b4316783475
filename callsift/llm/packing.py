"""Best-two-fit packing of documents into sequences of at most ``capacity`` tokens.

Each document is encoded once, ends with ``end_id``, and is cut only if it is longer
than a sequence.  Pieces are dealt at random into groups of about ``GROUP`` pieces;
a group is packed in one task from its piece lengths alone.  A sequence takes the
longest piece left and then, again and again, the longest that fits.  Then its
smallest piece gives way to two unpacked pieces if these fill the widened gap more
tightly; the smallest piece goes back.  The share of space lost by grouping is that
of the few last sequences of a group.

Nulls: a null text is empty (its end alone); a null doc_id is kept.  Repeated rows are
packed each on its own; an empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, prepare, text_bytes, written
from .wordids import default_path, word_ids

CAPACITY = 2048
GROUP = 40_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids_crc32", pa.int64()), ("deal", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of each document of ``docs`` (doc_id, text), and a random number to deal them by."""

    def cut(it):
        enc, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        for b in it:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                ids = enc.encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), random.getrandbits(40)))
            if rows:
                yield from batches(_PIECES, dict(zip(_PIECES.names, zip(*rows))))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES_DDL)


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of positions in ``lengths``, by best-two-fit."""
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        stock[lengths[i]].append(i)
    have = sum(1 << n for n in range(1, capacity + 1) if stock[n])
    out: list[list[int]] = [[i] for i in stock[0]]
    masks = [(1 << (n + 1)) - 1 for n in range(capacity + 1)]

    def take(n: int) -> int:
        nonlocal have
        i = stock[n].pop()
        if not stock[n]:
            have &= ~(1 << n)
        return i

    def put(i: int) -> None:
        nonlocal have
        stock[lengths[i]].append(i)
        have |= 1 << lengths[i]

    def longest(room: int) -> int:
        """The longest length in stock that fits; 0: none."""
        return max(0, (have & masks[room]).bit_length() - 1)

    while have:
        gap, row = capacity, []
        while gap and (n := longest(gap)):
            row.append(take(n))
            gap -= n
        small = lengths[row[-1]]  # the last taken is the shortest
        if gap and have:
            room, best = gap + small, (small, 0, 0)
            a = longest(room - 1)
            while a and 2 * a >= best[0] and best[0] < room:
                left = min(a, room - a)
                b = longest(left)
                if b == a and len(stock[a]) < 2:
                    b = longest(a - 1)
                if b and a + b > best[0]:
                    best = (a + b, a, b)
                a = longest(a - 1)
            if best[1]:
                put(row.pop())
                row += [take(best[1]), take(best[2])]
        out.append(row)
    return out


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece, with its sequence and its place there."""
    spark = docs.sparkSession
    prepare(spark)
    cut = written(pieces(docs, path or default_path(), capacity, end_id), "pack-pieces")
    groups = max(1, -(-cut.count() // GROUP))
    cut = cut.withColumn("deal", F.col("deal") % F.lit(groups))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pack(pdf["length"].tolist(), capacity)
        at = np.fromiter((i for r in rows for i in r), np.int64, len(pdf))
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        length = pdf["length"].to_numpy()[at]
        before = np.cumsum(length) - length
        first = np.repeat(np.cumsum(size) - size, size)
        got = pdf.iloc[at].drop(columns="deal")
        return got.assign(sequence_id=(int(pdf["deal"].iloc[0]) << 32) + np.repeat(np.arange(len(rows)), size), offset=before - before[first])

    return cut.groupBy("deal").applyInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
