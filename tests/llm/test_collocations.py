"""Collocations against counting every phrase of every piece."""

import random
import re
from collections import Counter
from fractions import Fraction
from math import floor

import pytest
from pyspark.sql import functions as F

from callsift.llm import collocations as C


def brute(rows, least, top, contained=80, longest=4):
    counts = Counter()
    for lang, text in rows:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    total = Counter()
    for (lang, p), n in counts.items():
        total[lang] += n * (len(p) == 1)
    frequent = {key: n for key, n in counts.items() if n >= least and len(key[1]) > 1}
    dropped = {(lang, p[i:i + k]) for (lang, p), n in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
               if 100 * n >= contained * counts[lang, p[i:i + k]]}
    out = {}
    for (lang, p), a in frequent.items():
        if (lang, p) not in dropped:
            score, k = min((floor(Fraction(2_000_000 * a, counts[lang, p[:k]] + counts[lang, p[k:]])), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, x, y, total[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(13)
    words = [f"w{i}" for i in range(12)] + ["Über", "ço", "日本", "W1"]
    fixed = ["once upon a time there was a long path of words that never ends", "a b c a b c a b c", "x x x x x x"]

    def text():
        parts = rnd.choices(fixed, k=rnd.randrange(3)) + [" ".join(rnd.choices(words, k=rnd.randrange(1, 9))) for _ in range(rnd.randrange(4))]
        rnd.shuffle(parts)
        return rnd.choice([". ", ", ", "\n", " ", "\t "]).join(parts)

    out = [(rnd.choice(["en", "en", "en", "de", None, "und"]), text()) for _ in range(400)]
    return out + [("en", None), ("en", ""), (None, " .;\t\r\n"), ("fr", "only one"), ("en", "tail word " * 300)] + out[:3]


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(lang, t, 1, "p") for lang, t in rows], "lang string, text string, n int, phrase string").repartition(5)
    return sorted(map(tuple, C.collocations(docs, **options).collect()))


@pytest.mark.parametrize("options", [{"least": 30, "top": 2000}, {"least": 5, "top": 40}, {"least": 3, "top": 2000, "cells": 1 << 6}])
def test_collocations_equal_brute_force(spark, rows, options, monkeypatch):
    """Also with a pair table so small that it prunes nothing, and with grams handed on after every batch."""
    monkeypatch.setattr(C, "HELD", 10)
    want = brute(rows, options["least"], options["top"])
    assert mined(spark, rows, **options) == want and want


def test_empty(spark):
    assert C.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert mined(spark, [("en", None), (None, "")]) == []


def test_paths_are_compacted(spark):
    sentence = "a b c d e f g h i j k l"
    docs = spark.createDataFrame([("en", sentence)] * 40 + [("en", "x d e f y")] * 35, "lang string, text string")
    C.prepare(spark)
    counts = C.phrase_counts(C.written(C.grams(docs, 4, 30, 1 << 12), "t"), 4, 30)
    paths = {}
    for r in C.unary_paths(counts[4], counts[3], 4).orderBy("path", "at").collect():
        paths.setdefault(r.path, []).append((r.at, r.phrase, r.n))
    # d e f also occurs elsewhere: the long path is cut there
    assert {p: [x[0] for x in v] for p, v in paths.items()} == {"a b c d": [0, 1, 2], "d e f g": list(range(6)), "x d e f": [0], "d e f y": [0]}
    assert all(n == 40 for p in ("a b c d", "d e f g") for *_, n in paths[p])


def test_counts_of_levels(spark, rows):
    """Node flow plus piece ends gives the count of every phrase, for each length."""
    docs = spark.createDataFrame(rows, "lang string, text string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    C.prepare(spark)
    counts = C.phrase_counts(C.written(C.grams(docs, 4, 1, 1 << 10), "t"), 4, 1)
    want = Counter()
    for lang, text in rows:
        for piece in C.pieces((text or "").encode()):
            for k in range(1, 5):
                want.update((k, lang or "und", b" ".join(piece[i:i + k]).decode()) for i in range(len(piece) - k + 1))
    assert {(k, r.lang, r.phrase): r.n for k, df in counts.items() for r in df.collect()} == want
