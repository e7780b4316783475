"""License scans against a brute-force comparison at every word."""

import random
import re

import pytest

from callsift.llm import license_scan as L

NOTICE = next(text for label, text, _, _ in L.NOTICES if label == "expat")


def brute(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
    places = []
    for kind in L.templates():
        m = len(kind.words)
        for o in range(-m, len(words) + m):
            n = sum(any(0 <= o + p + d < len(words) and words[o + p + d] == w for d in range(kind.slack + 1)) for p, w in enumerate(kind.words))
            inside = b" " + b" ".join(words[max(o, 0):max(o + m + kind.slack, 0)]) + b" "
            if n >= kind.need and all(b" " + b" ".join(k) + b" " in inside for k in kind.keys):
                places.append((kind.label, kind.base, o, n / m))
    base = [o for _, b, o, _ in places if b]
    return (len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({x for x, b, *_ in places if b})),
            ",".join(sorted({x for x, *_ in places})), max((s for *_, s in places), default=0.0))


def edited(rnd, n):
    words = NOTICE.split()
    for _ in range(n):
        at = rnd.randrange(len(words))
        kind = rnd.randrange(3)
        words[at:at + 1] = [["other"], [], [words[at], "more"]][kind]
    return "Before it. " + " ".join(words).capitalize() + ", and after it."


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    fixed = [None, "", " .,; ", "CC BY-NC 4.0 cc-by cc by sa", "gnu general public license", "GNU GENERAL PUBLIC LICENSE, version 3. MIT License MIT License",
             "general public license gnu", "mit", "Apache License, Version 2.0", "gnu " * 300 + "general public license", "ünder the mit licensé", "cc\nby",
             "free of charge obtaining a copy without restriction", "x" * 100_000 + " mit license" + " y" * 500, NOTICE, NOTICE + " " + NOTICE]
    vocabulary = sorted({w.decode() for k in L.templates() for w in k.words}) + ["and", "the"] * 20
    return fixed + [edited(rnd, n) for n in range(12) for _ in range(3)] + [" ".join(rnd.choices(vocabulary, k=200)) for _ in range(5)]


def test_license_labels_equal_brute_force(spark, texts):
    rows = [(i, t, "a", "b") for i, t in enumerate(texts)] + [(None, "MIT license", "a", "b"), (0, None, "a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, places string").repartition(3)
    got = L.license_labels(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got], key=key) == sorted(
        [(i, *brute(t)) for i, t, *_ in rows], key=key)
    assert any("expat" in r.labels for r in got) and any(0 < r.score < 1 for r in got)
    assert L.license_labels(docs.limit(0)).count() == 0


def test_index_loses_no_place_whatever_the_counts(texts):
    rnd = random.Random(5)
    kinds = L.templates()
    for _ in range(5):
        index = L.Index(kinds, {w: rnd.randrange(1000) for k in kinds for w in k.words})
        for t in texts:
            words = L.words_of((t or "").encode())
            found = {x["label"] for x in index.places(words)}
            assert ",".join(sorted(found)) == brute(t)[5]


def test_places(spark):
    rows = L.license_places(spark.createDataFrame([(1, "one two MIT license three " + NOTICE)], "doc_id long, text string")).first()
    assert [(p.label, p.base, p.start, p.share) for p in rows.places] == [("mit", True, 2, 1.0), ("expat", False, 5, 1.0)]
