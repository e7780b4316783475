"""Language labels of spans in mixed text: script ranges, word scores, Viterbi with a switching penalty.

A word's score for a language is the log-likelihood of its byte trigrams.  The script
of its first letter leaves only languages that were learnt in that script; a word
without letters, or in a script that no language has, scores alike for all.  Viterbi
runs over the words of many documents at once and pays ``SWITCH`` for a change.

Learnt from about ``PER_LANGUAGE`` documents of each language, chosen by a hash of the
id; a language below that number is learnt from all of its rows.

Nulls: a null text and a text without letters give ``und`` with score 0; a null lang is
not learnt from; a null doc_id is labelled all the same.  Ties go to the language with
more training rows, then the first by name.  Without training rows all are ``und``.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, prepare, text_bytes

PER_LANGUAGE = 1500
BUCKETS = 1 << 15
SWITCH = 8.0
#: A word says at most so much for or against a language, so that one odd word is no span.
WORD_LIMIT = 12.0
#: First and last code point of the scripts' main ranges.
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
           ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
           ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
           ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))
_NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
NO_LETTER = -1


def script_of(word: str) -> int:
    """The number of the first letter's script; -1 without a letter."""
    for ch in word:
        if ch.isalpha():
            c = ord(ch)
            return next((_NAMES.index(s) for s, lo, hi in SCRIPTS if lo <= c <= hi), 0)
    return NO_LETTER


def split_words(text: bytes, number: defaultdict) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each word between spaces; each word's count of them."""
    buf = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 2) - size - 2
    where = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    h = (buf[where] * 0x10001 + buf[where + 1] * 0x101 + buf[where + 2]) * 0x9E3779B1
    return (h >> 13) & (BUCKETS - 1), size


class Model:
    def __init__(self, langs: list[str], logs: np.ndarray, allowed: np.ndarray):
        self.langs, self.logs, self.allowed = langs, logs, allowed

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each word, none above 0; the script of each."""
        script = np.fromiter((script_of(w.decode("utf-8", "replace")) for w in words), np.int64, len(words))
        h, size = trigrams(words)
        s = np.add.reduceat(self.logs[h], np.cumsum(size) - size) if len(words) else np.zeros((0, len(self.langs)))
        may = self.allowed[script]
        s = np.where(may, s, -np.inf)
        s = np.maximum(s - s.max(1, initial=-1e300, keepdims=True), -WORD_LIMIT)
        s[(script == NO_LETTER) | ~may.any(1)] = 0
        return s, script


def viterbi(scores: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best language of each word; documents follow one another, ``size`` words each."""
    order = np.argsort(-size, kind="stable")
    start, size = (np.cumsum(size) - size)[order], size[order]
    n, longest = len(size), int(size.max(initial=0))
    stay = np.ones(scores.shape, bool)
    source = np.zeros(len(scores), np.int64)
    live = np.searchsorted(-size, -np.arange(longest), "left")  # documents with more than t words come first
    best = scores[start[:live[0]]].copy() if longest else np.zeros((0, scores.shape[1]))
    for t in range(1, longest):
        k = live[t]
        at, best_k = start[:k] + t, best[:k]
        top = best_k.argmax(1)
        change = best_k[np.arange(k), top][:, None] - SWITCH
        keep = best_k >= change
        stay[at], source[at] = keep, top
        best[:k] = np.where(keep, best_k, change) + scores[at]
    out = np.zeros(len(scores), np.int64)
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        k = live[t]
        at = start[:k] + t
        out[at] = state[:k]
        if t:
            state[:k] = np.where(stay[at, state[:k]], state[:k], source[at])
    return out


def train(docs: DataFrame, mod: int = 4, per_language: int = PER_LANGUAGE) -> Model:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), mod))
    count = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(count, key=lambda x: (-count[x], x))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(_NAMES) + 1, 0), bool))
    share = F.create_map(*itertools.chain(*((F.lit(x), F.lit(min(1.0, per_language / count[x]))) for x in langs)))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)

    def tally(it):
        seen = {x: np.zeros(BUCKETS + len(_NAMES), np.int64) for x in langs}
        for b in it:
            for lang, text in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                number = defaultdict(itertools.count().__next__)
                ids = split_words(text, number)
                if not len(ids):
                    continue
                words, times = list(number), np.bincount(ids)
                script = np.array([script_of(w.decode("utf-8", "replace")) for w in words])
                h, size = trigrams(words)
                seen[lang][:BUCKETS] += np.bincount(h, np.repeat(times * (script != NO_LETTER), size), BUCKETS).astype(np.int64)
                seen[lang][BUCKETS:] += np.bincount(script[script >= 0], times[script >= 0], len(_NAMES)).astype(np.int64)
        for lang, v in seen.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(v[at])], names=["lang", "at", "n"])

    rows = (known.where(unit < share[F.col("lang")]).select("lang", "text").mapInArrow(tally, "lang string, at long, n long")
            .groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas())  # at most BUCKETS rows a language
    seen = np.zeros((len(langs), BUCKETS + len(_NAMES)))
    seen[[langs.index(x) for x in rows["lang"]], rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy()
    grams, scripts = seen[:, :BUCKETS] + 0.1, seen[:, BUCKETS:]
    allowed = np.zeros((len(_NAMES) + 1, len(langs)), bool)  # the last row: no letter
    allowed[:-1] = (scripts >= 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1)).T
    return Model(langs, np.log(grams / grams.sum(1, keepdims=True)).T.copy(), allowed)


def label(model: Model, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its words' languages, lengths and whether they have letters."""
    number = defaultdict(itertools.count().__next__)
    ids = [split_words(t, number) for t in texts]
    scores, script = model.word_scores(list(number))
    length = np.fromiter(map(len, number), np.int64, len(number))
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    state = viterbi(scores[flat], size)
    cut = np.cumsum(size)[:-1]
    return list(zip(np.split(state, cut), np.split(length[flat], cut), np.split(script[flat] != NO_LETTER, cut)))


def spans(model: Model, text: str | None) -> list[tuple[int, int, str]]:
    """(first word, end, language) of the runs of one language in a text."""
    if not model.langs or not text:
        return []
    state = label(model, [text.encode()])[0][0]
    at = np.flatnonzero(np.diff(state, prepend=-1))
    return [(int(a), int(b), model.langs[state[a]]) for a, b in zip(at, [*at[1:], len(state)])]


def languages(docs: DataFrame, mod: int = 4) -> DataFrame:
    """The language with most bytes of words in its spans, and its share, for every row of ``docs`` (doc_id, text, lang)."""
    prepare(docs.sparkSession)
    model = train(docs, mod)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int64())])

    def predict(it):
        for b in it:
            name, score, runs = [], [], []
            for state, length, letters in label(model, text_bytes(b.column(2))) if model.langs else [([], [], np.zeros(0, bool))] * b.num_rows:
                if letters.any():
                    share = np.bincount(state[letters], length[letters], len(model.langs))
                    name.append(model.langs[int(share.argmax())])
                    score.append(float(share.max() / share.sum()))
                    runs.append(int(np.count_nonzero(np.diff(state))) + 1)
                else:
                    name.append("und")
                    score.append(0.0)
                    runs.append(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(runs, pa.int64())], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id"), mod).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")
