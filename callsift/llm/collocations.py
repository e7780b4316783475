"""Phrase collocations from a weighted de Bruijn graph of words.

Every position of a piece of text gives one gram: the next ``LONGEST`` words, fewer where the piece ends.
Grams of full length are the edges of the graph (from their first words to their last ones, nodes of
``LONGEST - 1`` words); the shorter ones are the piece ends.  So

* a node's count is the flow out of it plus the pieces that end with it, and the count of any shorter phrase
  is the sum over the phrases that lengthen it by a word plus the piece ends, level by level;
* a node whose whole count comes in by one edge and goes out by one edge is unary: such paths
  are compacted to one path of one weight (pointer doubling over the path starts).  A unary node
  occurs only inside its edges, with the same count, so it is dropped as a candidate there and then.

Two prunings lose nothing, as a phrase is never more frequent than any part of it: edges under the least
count are not stored in the graph (they stay in the flow), and a gram ends before the word with which it would hold
a phrase that surely stays under the least count.  Phrases of all lengths are counted in one table of hashed cells (summed over all
documents, saturating at 255; a cell's sum is never below a phrase's count), which comes back as one bit a cell.  The table
has a cell for every ``BYTES_A_CELL`` bytes of text, up to ``MOST_CELLS``, so the broadcast is at most an eighth of that in bytes;
on a corpus beyond that size it prunes less and less, and more grams are shuffled.

Counts are combined within a task, and grams are sent sorted and packed: a row for each part of a language, dealt by a gram's first two
words.  There is a part for every ``BYTES_A_PART`` bytes of text, so a part that is put together stays small.  Ranks are
taken within parts of a language first, so a language that holds most phrases is no single group.

Nulls: a null text is empty, a null language is ``und``.  Empty texts count nothing.  Repeated rows count each.
Pieces may be as long as the text.  Ties are ordered by count, then by the phrase's bytes.  An empty table gives no
rows.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, prepare, text_bytes, written

LONGEST, LEAST, TOP, CONTAINED = 4, 30, 2000, 80
#: Size of the table of cells (a byte each in a task, a bit each in the broadcast), and cells sent as one row.
BYTES_A_CELL, MOST_CELLS, SLAB = 16, 1 << 26, 1 << 16
#: Bytes of text for a part of the grams.
BYTES_A_PART = 1 << 22
#: Distinct grams that a task holds before it hands them on.
HELD = 500_000
#: Parts that a language's phrases are ranked in first.
PARTS = 32

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PIECES = re.compile(rb"[.,;:!?\x0A-\x0D]")
_GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])


def pieces(text: bytes) -> list[list[bytes]]:
    """The pieces of a text as lists of words."""
    text = text.translate(_LOWER).replace(b"\t", b" ")
    return [words for words in ([w for w in p.split(b" ") if w] for p in _PIECES.split(text)) if words]


class Cells:
    """Hashed cells of phrases; a worker keeps the hashes of the words it has met."""

    def __init__(self, cells: int, longest: int):
        self.cells, self.longest, self.hashes = np.uint64(cells - 1), longest, {}

    def hash(self, word: bytes) -> int:
        if len(self.hashes) > 500_000:
            self.hashes.clear()
        h = self.hashes[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, lang: str, words: list[bytes], piece: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per length the places where a phrase of one piece begins, and their cells."""
        known, out = self.hashes, []
        one = phrase = np.array([known.get(w) or self.hash(w) for w in words], np.uint64) + np.uint64(xxhash.xxh3_64_intdigest(lang))
        for k in range(1, min(self.longest, len(words)) + 1):
            if k > 1:
                phrase = mixed(phrase[:-1]) ^ one[k - 1:]
            at = np.flatnonzero(piece[k - 1:] == piece[:len(piece) - k + 1])
            out.append((at, (mixed(phrase[at]) & self.cells).astype(np.uint32)))
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """All words of a text and, for each, the number of its piece."""
    parts = pieces(text)
    return [w for p in parts for w in p], np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def table_size(size: int) -> int:
    """Cells for so many bytes of text, a power of two."""
    return min(MOST_CELLS, max(1 << 10, 1 << (size // BYTES_A_CELL).bit_length()))


def part_of(phrase: bytes, parts: int) -> int:
    return zlib.crc32(b" ".join(phrase.split(b" ", 2)[:2])) % parts


def packed_parts(lang: str, count: Counter, parts: int) -> pa.RecordBatch:
    """Counted phrases of a language, sorted, a row for each part."""
    by_part, pack = defaultdict(list), zstandard.ZstdCompressor(level=3).compress
    for phrase in sorted(count):
        by_part[part_of(phrase, parts)].append(phrase)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(by_part), pa.string()), pa.array(list(by_part), pa.int64()),
                                       pa.array([pack(b"\n".join(x)) for x in by_part.values()], pa.binary()),
                                       pa.array([pack(np.array([count[p] for p in x], "<u4").tobytes()) for x in by_part.values()], pa.binary())],
                                      ["lang", "part", "phrases", "counts"])


def put_together(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of a language: its phrases with their counts over all tasks."""
    total, unpack = Counter(), zstandard.ZstdDecompressor().decompress
    for batch in groups:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("phrases", "counts")]
        for phrases, counts in zip(*columns):
            for phrase, n in zip(unpack(phrases).split(b"\n"), np.frombuffer(unpack(counts), "<u4").tolist()):
                total[phrase] += n
    lang = key[0].as_py()
    yield from batches(_GRAMS, {"lang": [lang] * len(total), "phrase": [p.decode("utf-8", "replace") for p in total],
                                "words": [p.count(b" ") + 1 if p else 0 for p in total], "n": list(total.values())})


def frequent_cells(docs: DataFrame, longest: int, least: int, cells: int) -> np.ndarray:
    """Which cells hold at least ``least`` phrases, over all documents: a bit each."""
    slab = min(SLAB, cells)

    def count(it):
        table, kinds = np.zeros(cells, np.uint8), Cells(cells, longest)
        for batch in it:
            found = [np.zeros(0, np.uint32)]
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words, piece = flat(text)
                if words:
                    found += [cell for _, cell in kinds.of(lang, words, piece)]
            cell = np.sort(np.concatenate(found))
            start = np.flatnonzero(np.r_[cell[:1] == cell[:1], cell[1:] != cell[:-1]])
            n, cell = np.diff(np.r_[start, len(cell)]), cell[start]
            table[cell] = np.minimum(table[cell] + np.minimum(n, 255), 255)
        rows = table.reshape(-1, slab)
        pack = zstandard.ZstdCompressor(level=1).compress
        for some in np.array_split(np.flatnonzero(rows.any(1)), 16):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([pack(rows[s].tobytes()) for s in some], pa.binary())], ["slab", "counts"])

    def add(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros(slab, np.int64), zstandard.ZstdDecompressor().decompress
        for batch in groups:
            for c in batch.column(batch.schema.get_field_index("counts")).to_pylist():
                total += np.frombuffer(unpack(c), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= min(least, 255)).tobytes()], pa.binary())], ["slab", "bits"])

    bits = np.zeros(cells // 8, np.uint8).reshape(-1, slab // 8)
    counted = docs.mapInArrow(count, "slab int, counts binary")
    for r in counted.groupBy("slab").applyInArrow(add, "slab int, bits binary").collect():  # cells / 8 bytes at most
        bits[r.slab] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits.ravel()


def sizes(n: int, frequent: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Words of the gram at each of n positions: the longest phrase of which every part may be frequent (0: not even the word).

    ``frequent``: per length the places where a phrase begins and whether it may be.
    """
    size, whole = np.zeros(n, np.int64), None
    for at, may in frequent:
        now = np.zeros(n + 1, bool)
        now[at] = may if whole is None else may & whole[at] & whole[at + 1]
        size += now[:-1]
        whole = now
    return size


def grams(docs: DataFrame, longest: int, least: int, cells: int | None = None) -> DataFrame:
    """lang, phrase, words, n: how often each gram starts at a position (see the module's head).

    Positions whose word is surely under the least count are counted under the empty phrase.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, parts = cells or table_size(size), size // BYTES_A_PART + 1
    known = docs.sparkSession.sparkContext.broadcast(frequent_cells(docs, longest, least, cells))

    def cut(it):
        bits, kinds, held = known.value, Cells(cells, longest), defaultdict(Counter)
        frequent = lambda c: (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1

        def given():
            for lang, count in held.items():
                yield packed_parts(lang, count, parts)
            held.clear()

        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words, piece = flat(text)
                if words:
                    size = sizes(len(words), [(at, frequent(cell)) for at, cell in kinds.of(lang, words, piece)])
                    at = np.flatnonzero(size)
                    count = held[lang]
                    count[b""] += len(words) - len(at)
                    count.update([words[i] if n == 1 else b" ".join(words[i:i + n]) for i, n in zip(at.tolist(), size[at].tolist())])
            if sum(map(len, held.values())) > HELD:
                yield from given()
        yield from given()

    packs = docs.mapInArrow(cut, "lang string, part long, phrases binary, counts binary")
    return packs.groupBy("lang", "part").applyInArrow(put_together, "lang string, phrase string, words int, n long")


def first(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", k)


def last(phrase: Column, k: int) -> Column:
    return F.substring_index(phrase, " ", -k)


def phrase_counts(starts: DataFrame, longest: int, least: int) -> dict[int, DataFrame]:
    """Per length the counts (lang, phrase, n) of at least ``least``: edges, then node flow plus piece ends, level by level."""
    whole = starts.where(F.col("words") == longest).select("lang", "phrase", "n")
    out = {longest: whole.where(F.col("n") >= least)}
    for k in range(longest - 1, 0, -1):
        ends = starts.where(F.col("words") == k).select("lang", "phrase", "n")
        flow = whole.select("lang", first(F.col("phrase"), k).alias("phrase"), "n")
        whole = flow.unionByName(ends).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if k > 1:
            whole = written(whole, f"grams-{k}")  # read again by the next level
        out[k] = written(whole.where(F.col("n") >= least), f"phrases-{k}")
    return out


def unary_paths(edges: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """lang, path, at, phrase, n for every edge: compacted paths whose inner nodes are unary.

    ``path`` is the path's first edge.  A node is unary if one edge brings its whole count and one takes it.
    A path has a start, as every occurrence of a node begins in some piece; so the pointers end.
    """
    node = nodes.select("lang", F.col("phrase").alias("node"), F.col("n").alias("flow"))
    ends = edges.select("lang", "phrase", "n", last(F.col("phrase"), size - 1).alias("node"))
    begins = edges.select("lang", F.col("phrase").alias("next"), F.col("n").alias("flow"), first(F.col("phrase"), size - 1).alias("node"))
    full = ends.join(node, ["lang", "node"]).where("n = flow").select("lang", "node", F.col("phrase").alias("before"), "flow")
    link = written(full.join(begins, ["lang", "node", "flow"]).select("lang", "before", "next"), "links")
    # the edges on the way: each points to one before it and knows how far that is
    state = written(edges.join(link.withColumnRenamed("next", "phrase"), ["lang", "phrase"], "left")
                    .select("lang", "phrase", "n", F.coalesce("before", "phrase").alias("path"), F.col("before").isNotNull().cast("long").alias("at")), "paths")
    settled, moving = state.where("at = 0"), state.where("at > 0")
    while not moving.isEmpty():
        to = [F.col("phrase").alias("path"), F.col("path").alias("start"), F.col("at").alias("step")]
        points = settled.select("lang", *to, F.lit(True).alias("final")).unionByName(moving.select("lang", *to, F.lit(False).alias("final")))
        step = written(moving.join(points, ["lang", "path"]).select("lang", "phrase", "n", F.col("start").alias("path"), (F.col("at") + F.col("step")).alias("at"), "final"), "paths")
        settled, moving = settled.unionByName(step.where("final").drop("final")), step.where("not final").drop("final")
    return settled


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, contained: int = CONTAINED, longest: int = LONGEST, cells: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to ``longest`` words."""
    prepare(docs.sparkSession)
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    starts = written(grams(docs, longest, least, cells), "grams")
    counts = phrase_counts(starts, longest, least)
    total = starts.groupBy("lang").agg(F.sum("n").alias("total"))
    paths = unary_paths(counts[longest], counts[longest - 1], longest)
    # inner nodes of a path: the ends of its edges that another edge follows
    follows = paths.where("at > 0").select("lang", first(F.col("phrase"), longest - 1).alias("phrase"))
    candidate = counts[longest].withColumn("words", F.lit(longest))
    for k in range(2, longest):
        some = counts[k].join(follows, ["lang", "phrase"], "left_anti") if k == longest - 1 and contained <= 100 else counts[k]
        candidate = candidate.unionByName(some.withColumn("words", F.lit(k)))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    inside = None  # the most frequent longer candidate around each phrase
    for k in range(3, longest + 1):
        for j in range(2, k):
            part = counts[k].select("lang", F.explode(F.array(*[last(first(F.col("phrase"), i + j), j) for i in range(k - j + 1)])).alias("phrase"), "n")
            inside = part if inside is None else inside.unionByName(part)
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    candidate = candidate.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("n") * contained)).drop("longer")
    candidate = written(candidate.withColumnRenamed("n", "a"), "candidates")
    # both sides of every cut, looked up among all frequent phrases
    known = counts[1]
    for k in range(2, longest):
        known = known.unionByName(counts[k])
    cuts = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), first(F.col("phrase"), k).alias("left"), F.substring(F.col("phrase"), F.length(first(F.col("phrase"), k)) + 2, F.length("phrase")).alias("right"))
                              for k in range(1, longest)]), lambda c: c["k"] < F.col("words"))
    cut = candidate.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    side = known.withColumnRenamed("phrase", "side")
    cut = cut.join(side.withColumnsRenamed({"side": "left", "n": "l"}), ["lang", "left"]).join(side.withColumnsRenamed({"side": "right", "n": "r"}), ["lang", "right"])
    score = F.expr("cast(a as decimal(38,0)) * 2000000 div (cast(l as decimal(38,0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    scored = cut.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return scored.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


#: Every phrase of every piece, without a graph.
ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
words AS (SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
starts AS MATERIALIZED (
  SELECT lang, w AS w1, lead(w, 1) OVER piece AS w2, lead(w, 2) OVER piece AS w3, lead(w, 3) OVER piece AS w4
  FROM words WINDOW piece AS (PARTITION BY p ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM starts GROUP BY lang),
freq AS MATERIALIZED (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM starts GROUP BY ALL HAVING count(*) >= {LEAST} UNION ALL
  SELECT lang, 2, w1 || ' ' || w2, count(*) FROM starts WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST} UNION ALL
  SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM starts WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST} UNION ALL
  SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM starts WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
kept AS MATERIALIZED (
  SELECT lang, k AS words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM freq c WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM freq b WHERE b.lang = c.lang AND b.k > c.k AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ')
     AND 100 * b.f::HUGEINT >= {CONTAINED} * c.f::HUGEINT)),
cuts AS (
  SELECT kept.lang, kept.phrase, a, cut.k, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM kept JOIN (SELECT unnest(range(1, {LONGEST})) AS k) cut ON cut.k < words
  JOIN freq l ON l.lang = kept.lang AND l.phrase = array_to_string(kept.ws[1:cut.k], ' ')
  JOIN freq r ON r.lang = kept.lang AND r.phrase = array_to_string(kept.ws[cut.k + 1:], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest JOIN total USING (lang) QUALIFY rank <= {TOP}
"""
