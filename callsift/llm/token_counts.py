"""Token counts by a unigram model: dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word behind the mark U+2581.  Its count is that of the segmentation
with the highest sum of piece scores; ties go to the fewer tokens.  The pieces are a
public vocabulary; a piece's score falls with its rank (a Zipf prior, -ln(rank + 2)),
and a byte that no piece covers costs ``BYTE_COST`` more than the last piece.

The distinct pre-tokens of a block of texts are sorted, so that those with a common
prefix follow one another.  Each distinct prefix is one node, whose forward score is
computed once, for all nodes of a depth at a time; the counts are read at the words' ends.

Nulls: a null or empty text has no tokens; a null doc_id is kept.  Repeated rows are
counted each; an empty table gives no rows.  Words longer than ``DEEP`` bytes are
scored one by one, by the same rule.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, prepare, text_bytes

BLOCK_BYTES = 12 << 20
BYTE_COST = 10.0
DEEP = 64
MARK = "▁".encode()
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Scores of a vocabulary's pieces, by their bytes and by a 64-bit hash of them."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[bytes, float] = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                self.score.setdefault(model.id_to_piece(i).encode(), -math.log(i + 2))
        self.byte = -math.log(model.get_piece_size() + 2) - BYTE_COST
        self.longest = max(map(len, self.score), default=1)
        self.by_length = {}
        for n in range(1, self.longest + 1):
            own = [p for p in self.score if len(p) == n]
            if own:
                h = np.zeros(len(own), np.uint64)
                for column in np.frombuffer(b"".join(own), np.uint8).reshape(-1, n).T:
                    h = h * _BASE + column + np.uint64(1)
                order = np.argsort(h)
                self.by_length[n] = h[order], np.array([self.score[p] for p in own])[order]

    def count(self, word: bytes) -> int:
        """Tokens of one pre-token."""
        best = [(0.0, 0)]
        for d in range(1, len(word) + 1):
            s, k = best[d - 1]
            top = (s + self.score.get(word[d - 1:d], self.byte), k - 1)
            for n in range(2, min(d, self.longest) + 1):
                p = self.score.get(word[d - n:d])
                if p is not None:
                    s, k = best[d - n]
                    top = max(top, (s + p, k - 1))
            best.append(top)
        return -best[-1][1]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of sorted distinct pre-tokens of at most ``DEEP`` bytes."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        buf = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        start = np.cumsum(size) - size
        # at each depth: the words that reach it, the node of each, and per node: hash, score, count
        node = [np.zeros(len(words), np.int32)]
        values = [(np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int32))]
        power = [np.uint64(1)]
        for d in range(1, int(size.max(initial=0)) + 1):
            at = np.flatnonzero(size >= d)
            parent, byte = node[-1][at], buf[start[at] + d - 1]
            new = np.ones(len(at), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (byte[1:] != byte[:-1])
            own = np.full(len(words), -1, np.int32)
            own[at] = np.cumsum(new) - 1
            rep = at[new]  # a word for each node
            h = values[-1][0][parent[new]] * _BASE + byte[new] + np.uint64(1)
            power.append(power[-1] * _BASE)
            score, n = np.full(len(rep), -np.inf), np.zeros(len(rep), np.int32)
            for k in range(1, min(d, self.longest) + 1):
                before = node[d - k][rep]
                bh, bs, bn = (v[before] for v in values[d - k])
                piece = h - bh * power[k]
                keys, logs = self.by_length.get(k, (np.zeros(0, np.uint64), np.zeros(0)))
                if len(keys):
                    i = np.minimum(np.searchsorted(keys, piece), len(keys) - 1)
                    own_log = np.where(keys[i] == piece, logs[i], self.byte if k == 1 else -np.inf)
                else:
                    own_log = np.full(len(rep), self.byte if k == 1 else -np.inf)
                s = bs + own_log
                better = (s > score) | ((s == score) & (bn + 1 < n))
                score, n = np.where(better, s, score), np.where(better, bn + 1, n)
            node.append(own)
            values.append((h, score, n))
            end = np.flatnonzero(size == d)
            out[end] = n[own[end]]
        return out


_OPEN: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def count(it):
        model = pieces(path)
        number, held, size = defaultdict(itertools.count().__next__), [], 0

        def full():
            words = [MARK + w for w in number]
            order = sorted((i for i, w in enumerate(words) if len(w) <= DEEP), key=words.__getitem__)
            n = np.zeros(len(words) + 1, np.int64)
            n[order] = model.counts([words[i] for i in order])
            for i, w in enumerate(words):
                if len(w) > DEEP:
                    n[i] = model.count(w)
            ids = [x for _, x in held]
            yield from batches(schema, {"doc_id": [d for d, _ in held], "n_pretokens": list(map(len, ids)), "n_tokens": [int(n[x].sum()) for x in ids]})

        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                words = text.split()
                held.append((doc_id, np.fromiter(map(number.__getitem__, words), np.int32, len(words))))
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield from full()
                    number, held, size = defaultdict(itertools.count().__next__), [], 0
        if held:
            yield from full()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_pretokens long, n_tokens long")
