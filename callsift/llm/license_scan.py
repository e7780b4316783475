"""License scans with a positional index of rare words.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.  A template is a
row of words with a label; it stands at word ``o`` of a text if at least a share of its positions
hold their word at a drift of 0 to ``slack`` words (text position - template position - o), and each of its
key phrases stands word by word inside the window.  Short templates (the ``BASE`` phrases among them)
need every position at drift 0.

1. One pass counts in how many documents each template word occurs (whole table; the counts are one
   number per word of the fixed templates).
2. Each template's index holds its positions with the highest IDF only, as many as it may miss and
   two more.  A text that holds the template therefore shows two of them (one, if the template is one word) at nearly the
   same offset, so no template is lost, however common its other words are.
3. A text looks up its words in the index, gathers postings by template and relative position, and
   only where enough agree compares the whole template and its key phrases.

Work and memory are one document's words at a time; nothing is shuffled but the counts.

Nulls: a null text is empty (no words, no places); a null doc_id is kept.  Repeated rows are each answered.
An empty table gives no rows.  Very long texts are read whole.  Other columns of the table are not read, so
their names do not matter.  Ties: of equally good overlapping windows the last counts.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_bytes

# ---- fixed values: phrases and labels of the contract, then notices as their licences print them
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: (label, words, share of the words that must stand, key phrases)
NOTICES = [
    ("gpl-2.0", "gnu general public license version 2", 1.0, ()),
    ("gpl-3.0", "gnu general public license version 3", 1.0, ()),
    ("lgpl", "gnu lesser general public license", 1.0, ()),
    ("agpl", "gnu affero general public license", 1.0, ()),
    ("apache-2.0", "apache license version 2 0", 1.0, ()),
    ("cc-by-nc", "cc by nc", 1.0, ()),
    ("cc-by-sa", "cc by sa", 1.0, ()),
    ("cc-by-nd", "cc by nd", 1.0, ()),
    ("cc-by-nc-sa", "cc by nc sa", 1.0, ()),
    ("cc-by-nc-nd", "cc by nc nd", 1.0, ()),
    ("cc0", "cc0 1 0 universal", 1.0, ()),
    ("mpl-2.0", "mozilla public license v 2 0", 1.0, ()),
    ("mpl-2.0", "mozilla public license version 2 0", 1.0, ()),
    ("epl-2.0", "eclipse public license v 2 0", 1.0, ()),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation", 0.8, ("free software", "redistribute it and or modify it")),
    ("gpl-notice", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
     "merchantability or fitness for a particular purpose", 0.8, ("without any warranty", "implied warranty of")),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 0.8,
     ("apache license", "except in compliance with the license")),
    ("expat", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction", 0.8, ("free of charge", "obtaining a copy", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
     "the above copyright notice and this permission notice appear in all copies", 0.8, ("with or without fee", "is hereby granted")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
     "are met", 0.8, ("source and binary forms", "are permitted provided that")),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
     "from this software without specific prior written permission", 0.8, ("endorse or promote products", "prior written permission")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.8, ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.8, ("unencumbered software", "public domain")),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
     "damages arising from the use of this software", 0.8, ("express or implied warranty", "held liable")),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license", 0.8, ("person or organization obtaining", "accompanying documentation")),
    ("cc-by-notice", "this work is licensed under a creative commons attribution", 0.8, ("creative commons attribution",)),
]
# ---- end of fixed values

#: Words that may be put into or taken out of a long template.
SLACK = 2

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())]))
SCHEMA = "doc_id {id}, n_words long, places array<struct<label:string,base:boolean,start:long,n_words:long,share:double>>"


class Template(NamedTuple):
    label: str
    base: bool
    words: tuple[bytes, ...]
    need: int
    slack: int
    keys: tuple[tuple[bytes, ...], ...]


def template(label: str, text: str, share: float = 1.0, keys: tuple[str, ...] = (), base: bool = False) -> Template:
    words = tuple(text.encode().split())
    return Template(label, base, words, max(1, round(share * len(words))), SLACK if share < 1 else 0, tuple(tuple(k.encode().split()) for k in keys))


def templates() -> list[Template]:
    return [template(label, text, base=True) for text, label in BASE.items()] + [template(*x) for x in NOTICES]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Index:
    """Postings (template, position) of each template's words with the highest IDF."""

    def __init__(self, kinds: list[Template], seen_in: dict[bytes, int]):
        self.kinds, self.postings, self.agree = kinds, defaultdict(list), []
        for t, kind in enumerate(kinds):
            rarest = sorted(range(len(kind.words)), key=lambda p: (seen_in.get(kind.words[p], 0), kind.words[p], p))
            spare = len(kind.words) - kind.need
            indexed = rarest[:spare + min(2, kind.need)]
            self.agree.append(len(indexed) - spare)
            for p in indexed:
                self.postings[kind.words[p]].append((t, p))
        self.postings = dict(self.postings)

    def places(self, words: list[bytes]) -> list[dict]:
        """Every place of every template, in the order of the templates and words."""
        postings = self.postings
        offsets = defaultdict(set)
        for i in [i for i, w in enumerate(words) if w in postings]:
            for t, p in postings[words[i]]:
                offsets[t].add((i - p, p))
        out = []
        for t in sorted(offsets):
            if len(offsets[t]) >= self.agree[t]:
                out += self._verified(self.kinds[t], self.agree[t], offsets[t], words)
        return out

    @staticmethod
    def _verified(kind: Template, agree: int, hits: set, words: list[bytes]) -> list[dict]:
        at = defaultdict(set)  # indexed positions that a window at o sees
        for off, p in hits:
            for o in range(off - kind.slack, off + 1):
                at[o].add(p)
        found = [(o, n) for o in sorted(at) if len(at[o]) >= agree and (n := stands(kind, o, words))]
        out, m = [], len(kind.words)
        for o, n in found:
            place = {"label": kind.label, "base": kind.base, "start": max(o, 0), "n_words": m, "share": n / m}
            if out and kind.slack and o - out[-1][0] < m:  # windows of one place
                if n >= out[-1][1]:
                    out[-1] = o, n, place
            else:
                out.append((o, n, place))
        return [place for *_, place in out]


def stands(kind: Template, o: int, words: list[bytes]) -> int:
    """The positions that a window at ``o`` holds; 0 if they are too few or a key phrase is missing."""
    n = 0
    for p, w in enumerate(kind.words):
        n += w in words[max(o + p, 0):max(o + p + kind.slack + 1, 0)]
    if n < kind.need:
        return 0
    window = words[max(o, 0):o + len(kind.words) + kind.slack]
    for key in kind.keys:
        if not any(tuple(window[i:i + len(key)]) == key for i in range(len(window) - len(key) + 1)):
            return 0
    return n


def word_documents(docs: DataFrame, kinds: list[Template]) -> dict[bytes, int]:
    """In how many documents each template word occurs; one number per word of the templates."""
    vocabulary = {w for k in kinds for w in k.words}

    def count(it):
        n = Counter()
        for batch in it:
            for text in text_bytes(batch.column(0)):
                n.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(n), pa.binary()), "n": pa.array(list(n.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def license_places(docs: DataFrame, kinds: list[Template] | None = None) -> DataFrame:
    """doc_id, n_words and the places (label, base, start, n_words, share) of the templates, for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    kinds = kinds or templates()
    index = Index(kinds, word_documents(docs, kinds))

    def scan(it):
        for batch in it:
            n, places = [], []
            for text in text_bytes(batch.column(1)):
                words = words_of(text)
                n.append(len(words))
                places.append(index.places(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(places, _PLACES)], ["doc_id", "n_words", "places"])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def license_labels(docs: DataFrame) -> DataFrame:
    """The digest of ``license_places``: one row per document with the places of the base phrases, the labels and the best share."""
    rows = license_places(docs)
    base = F.filter("places", lambda x: x["base"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: x["label"]))), ",")
    return rows.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)).alias("score"))


def _values() -> tuple[str, str, str]:
    kinds = templates()
    kind = [f"({t}, '{k.label}', {k.base}, {len(k.words)}, {k.need}, {k.slack}, {len(k.keys)})" for t, k in enumerate(kinds)]
    word = [f"({t}, {p}, '{w.decode()}')" for t, k in enumerate(kinds) for p, w in enumerate(k.words)]
    key = [f"({t}, {i}, {len(key)}, {j}, '{w.decode()}')" for t, k in enumerate(kinds) for i, key in enumerate(k.keys) for j, w in enumerate(key)]
    return ", ".join(kind), ", ".join(word), ", ".join(key)


_KIND, _WORD, _KEY = _values()
#: Every template word of every text, without an index.
ORACLE = rf"""
WITH kind(t, label, base, m, need, slack, n_keys) AS (VALUES {_KIND}),
word(t, p, w) AS (VALUES {_WORD}),
phrase(t, k, size, j, w) AS (VALUES {_KEY}),
texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
flat AS MATERIALIZED (
  SELECT doc_id, i - 1 AS i, w FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM texts)
  WHERE w IN (SELECT w FROM word)),
hits AS MATERIALIZED (
  SELECT f.doc_id, k.t, k.m, k.need, k.slack, k.n_keys, word.p, f.i - word.p - d.d AS o
  FROM flat f JOIN word ON f.w = word.w JOIN kind k ON word.t = k.t JOIN (SELECT unnest(range({SLACK + 1})) AS d) d ON d.d <= k.slack),
windows AS MATERIALIZED (
  SELECT doc_id, t, o, any_value(m) AS m, any_value(slack) AS slack, any_value(n_keys) AS n_keys, count(DISTINCT p) AS n
  FROM hits GROUP BY doc_id, t, o HAVING count(DISTINCT p) >= any_value(need)),
keys AS MATERIALIZED (
  SELECT f.doc_id, x.t, x.k, any_value(x.size) AS size, f.i - x.j AS at
  FROM flat f JOIN phrase x ON f.w = x.w GROUP BY f.doc_id, x.t, x.k, f.i - x.j HAVING count(*) = any_value(x.size)),
held AS (
  SELECT w.doc_id, w.t, w.o, count(DISTINCT keys.k) AS n FROM windows w JOIN keys ON w.doc_id = keys.doc_id AND w.t = keys.t
   AND keys.at >= w.o AND keys.at + keys.size <= w.o + w.m + w.slack GROUP BY w.doc_id, w.t, w.o),
places AS (
  SELECT w.doc_id, kind.label, kind.base, w.o, w.n / w.m AS share FROM windows w JOIN kind ON w.t = kind.t
  LEFT JOIN held ON w.doc_id = held.doc_id AND w.t = held.t AND w.o = held.o WHERE coalesce(held.n, 0) = w.n_keys),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(o) FILTER (WHERE base) AS first_word, max(o) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM places GROUP BY doc_id)
SELECT texts.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM texts LEFT JOIN found ON texts.doc_id = found.doc_id
"""
