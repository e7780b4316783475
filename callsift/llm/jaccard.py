"""Components of the exact Jaccard join on word n-grams, by T-occurrence search with DivideSkip.

The operator gives components, not the pairs of the join: links inside a component are not all searched.

A linked pair shares at least T = 85 % of either set, so in any one order of all
shingles the two share one of their first n - T + 1.  The order is by hash, with the
shingles that are frequent in a bounded sample last: those lists are long and are
reached only by documents made of little else (any order gives the same links).

1. one pass over the text: set size, a class id (hash of the set; equal sets are one
   class), and the first shingles in the order;
2. one shuffle by shingle; each inverted list is read in a stream.  A first round takes
   the pairs of each list's centre with the others, verifies them and joins them
   into components; a second takes all pairs of a list that lie in different components
   and share so many first shingles that they can still reach the overlap.  So groups
   of near copies never meet pairwise, and no link between components is missed.  Sets that meet
   many others carry their first shingles along, so that a pair of them is counted in the first
   list where it meets and written only if it can reach the overlap;
3. verification, per query class and chunk of its candidates: inverted lists of the
   query's shingles over the candidates, the longest set aside; the short lists are
   merged into counts, and only candidates that can still reach T are probed in the long
   lists by binary search.

Nulls and texts without words have an empty set and link with nothing; a null doc_id
keeps its row, as a component of its own with a null id unless its class has an id.
Repeated rows fall into one class.  An empty table gives no rows.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, text_bytes, written
from .components import components

WORDS = 4
PERCENT = 85
#: Documents whose shingles decide which are frequent, and in how many of them a frequent one occurs.
SAMPLE, FREQUENT = 8000, 4
#: Candidates that a query is verified against at a time, and in one task.
CHUNK, TASK = 256, 2000
#: A set that meets CROWD sets of other components or more in its lists carries its first shingles along if they are at
#: most CARRIED; two such sets are counted where they first meet.  The result is the same at any numbers.
CROWD, CARRIED = 2000, 128
#: Rows (about 24 bytes each) up to which the places that sets are sent to are broadcast; beyond it Spark shuffles the texts.
BROADCAST_ROWS = 1_000_000

_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sorted distinct shingle hashes of texts; word hashes are kept from text to text."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, _WordHash()

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        if not k:
            return np.zeros(0, np.int64)
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = _mix(out * _M + h[j:len(h) - k + 1 + j])
        return np.unique(out.view(np.int64))


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def needed(n, percent: int):
    """The least overlap that a linked partner has with a set of size n."""
    return -(-percent * n // 100)


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that FREQUENT or more different sets of a sample of at most about SAMPLE documents hold."""
    count = docs.count()

    def tokens(it):
        cut = Shingler(words)
        for b in it:
            sets = list(map(cut, text_bytes(b.column(0))))
            if sets:
                c = np.repeat(np.array(list(map(class_of, sets))), list(map(len, sets)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(c)], names=["t", "c"])

    unit = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(count, 1)))
    seen = docs.where(unit).select("text").mapInArrow(tokens, "t long, c long").distinct().groupBy("t").count().where(F.col("count") >= FREQUENT)
    return np.sort(seen.select("t").toPandas()["t"].to_numpy(np.int64))  # bounded by the sample


def _runs(columns: list, it, emit):
    """Call ``emit`` with the arrays of whole runs of equal first column; batches come sorted by it."""
    rest = None
    for b in it:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in columns]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        if not len(now[0]):
            continue
        last = np.searchsorted(now[0], now[0][-1], "left")
        rest = [x[last:] for x in now]
        if last:
            yield from emit(*(x[:last] for x in now))
    if rest is not None and len(rest[0]):
        yield from emit(*rest)


def _enough(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share enough of their first shingles; ``pairs``: a row (a, b, n_a, n_b) per shared one.

    What a linked pair shares beyond its first shingles is at most the rest of the set whose
    first shingles end earlier; the other shared ones are all in both inverted lists.
    """
    n = F.col("n_a") + F.col("n_b")
    overlap = F.ceil(percent * n / (100 + percent) - 1e-9)
    rest = F.ceil(percent * F.greatest("n_a", "n_b") / 100 - 1e-9) - 1
    return pairs.groupBy("a", "b", "n_a", "n_b").agg(F.sum("c").alias("c")).where(F.col("c") >= overlap - rest).select("a", "b")


def _meetings(held: list, token: int):
    """A function of i: with how many of its numbers below ``token``, and of all, each of ``held`` shares i's (None: has none)."""
    own = np.repeat(np.arange(len(held)), [0 if x is None else len(x) for x in held])
    flat = np.concatenate([x for x in held if x is not None])
    order = np.argsort(flat, kind="stable")
    flat, own = flat[order], own[order]

    def count(numbers: np.ndarray) -> np.ndarray:
        ends = zip(np.searchsorted(flat, numbers, "left").tolist(), np.searchsorted(flat, numbers, "right").tolist())
        return np.bincount(np.concatenate([own[:0], *(own[lo:hi] for lo, hi in ends)]), minlength=len(held))

    def of(i: int) -> tuple[np.ndarray, np.ndarray]:
        cut = np.searchsorted(held[i], token)
        before = count(held[i][:cut])
        return before, before + count(held[i][cut:])

    return of


def divide_skip(query: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of ``sets`` reach the overlap with ``query``; all are sorted distinct numbers."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    token, owner = at[hit], owner[hit]
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]  # inverted lists, each sorted by candidate
    length = np.bincount(token, minlength=len(query))
    ends = np.cumsum(length)
    least = int(needed(len(query), percent))
    skip = min(least - 1, int(least / (1 + 0.01 * np.log2(max(2, length.max(initial=1))))) // 2)
    long_lists = np.argsort(-length, kind="stable")[:max(skip, 0)]
    is_long = np.zeros(len(query), bool)
    is_long[long_lists] = True
    count = np.bincount(owner[~is_long[token]], minlength=len(sets))
    alive = np.flatnonzero(count >= least - len(long_lists))
    for t in long_lists:
        own = owner[ends[t] - length[t]:ends[t]]
        if len(own):
            i = np.minimum(np.searchsorted(own, alive), len(own) - 1)
            count[alive] += own[i] == alive
    good = np.zeros(len(sets), bool)
    good[alive] = 100 * count[alive] >= percent * (len(query) + size[alive] - count[alive])
    return good


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The linked ones of ``pairs`` (a, b), by their whole sets."""
    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / TASK).cast("int").alias("chunks"))
    queries = chunks.select(F.col("a").alias("cid"), "a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("b"))
    others = pairs.join(chunks, "a").select(F.col("b").alias("cid"), "a", F.pmod(F.hash("b"), "chunks").alias("chunk"), "b")
    ways = queries.unionByName(others).join(classes.select("cid", "doc_id"), "cid")
    ways = written(ways.groupBy("doc_id", "cid").agg(F.collect_list(F.struct("a", "chunk", "b")).alias("ways")), "join-ways")
    n = ways.agg(F.coalesce(F.sum(F.size("ways")), F.lit(0))).first()[0]
    side = F.broadcast(ways) if n <= BROADCAST_ROWS else ways  # else the texts are shuffled
    rows = docs.select("doc_id", "text").join(side, "doc_id").select("text", "cid", "ways")

    def send(it):
        shingle = Shingler(words)
        for b in it:
            a_, chunk, b_, tokens = [], [], [], []
            for text, cid, ways in zip(text_bytes(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = shingle(text)
                if class_of(t) == cid:  # another row may have the same doc_id
                    for w in ways:
                        a_.append(w["a"])
                        chunk.append(w["chunk"])
                        b_.append(w["b"])
                        tokens.append(t.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(a_, pa.int64()), pa.array(chunk, pa.int32()), pa.array(b_, pa.int64()), pa.array(tokens, pa.binary())],
                                             names=["a", "chunk", "b", "tokens"])

    def search(it):
        query, held, key = None, [], None

        def full():
            found = [b for (b, _), ok in zip(held, divide_skip(query, [t for _, t in held], percent)) if ok]
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

        for batch in it:
            for a, chunk, b, tokens in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != (a, chunk) or len(held) >= CHUNK:
                    if held:
                        yield full()
                    held, key = [], (a, chunk)
                tokens = np.frombuffer(tokens, np.int64)
                if b is None:
                    query = tokens
                else:
                    held.append((b, tokens))
        if held:
            yield full()

    both = rows.mapInArrow(send, "a long, chunk int, b long, tokens binary").repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return written(both.mapInArrow(search, "a long, b long"), "join-links")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    late = _frequent(docs, words)

    def index(it):
        shingle = Shingler(words)
        for b in it:
            sets = list(map(shingle, text_bytes(b.column(1))))
            first = []
            for t in sets:
                if len(late) and len(t):
                    i = np.minimum(np.searchsorted(late, t), len(late) - 1)
                    common = late[i] == t
                    first.append(np.concatenate([t[~common], t[common]])[:len(t) - needed(len(t), percent) + 1])
                else:
                    first.append(t[:len(t) - needed(len(t), percent) + 1])
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            cid = pa.array([class_of(t) if len(t) else None for t in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), cid, pa.array(first, pa.list_(pa.int64()))], names=["doc_id", "n", "cid", "first"])

    rows = written(docs.mapInArrow(index, "doc_id long, n long, cid long, first array<long>"), "join-index")
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
    lists = (rows.where("cid is not null and doc_id is not null").select("doc_id", "cid", "n", "first").join(classes, ["cid", "doc_id"], "left_semi")
             .dropDuplicates(["cid"]).select("cid", "n", F.explode("first").alias("token")).select("token", "cid", "n")
             .repartition("token").sortWithinPartitions("token", "n", "cid"))

    def shared(it):
        def emit(token, cid, n):
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            run = np.cumsum(new) - 1
            size = np.bincount(run)[run]
            many = size > 1
            yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (token, cid, n, size)], names=["token", "cid", "n", "size"])

        yield from _runs([0, 1, 2], it, emit)

    lists = written(lists.mapInArrow(shared, "token long, cid long, n long, size long"), "join-lists")
    # the centre of a list, among sets of about one size, is the one whose first shingles are shared most
    band = F.floor(F.log("n") / F.log(F.lit(100 / percent))).alias("band")
    drawn = lists.groupBy("cid").agg((F.sum("size") / F.first("n")).alias("drawn"))
    lists = lists.select("token", "cid", "n")
    lead = (lists.join(drawn, "cid").select("token", band, "cid", "n", "drawn").groupBy("token", "band")
            .agg(F.max(F.struct("drawn", (-F.col("cid")).alias("cid"), F.col("n").alias("lead_n"))).alias("lead"))
            .select("token", "band", (-F.col("lead.cid")).alias("lead"), "lead.lead_n"))
    first = F.col("cid") < F.col("lead")
    stars = lists.select("token", band, "cid", "n").join(lead, ["token", "band"]).where("cid <> lead")
    stars = stars.select(F.least("cid", "lead").alias("a"), F.greatest("cid", "lead").alias("b"), F.when(first, F.col("n")).otherwise(F.col("lead_n")).alias("n_a"),
                         F.when(first, F.col("lead_n")).otherwise(F.col("n")).alias("n_b"), F.lit(1).alias("c"))
    stars = written(_enough(stars, percent), "join-pairs")
    links = _verified(stars, classes, docs, words, percent)
    near = components(links)

    def across(it):
        def emit(token, cid, n, root, held):
            bounds, found = np.flatnonzero(np.diff(token)) + 1, [np.zeros((5, 0), np.int64)]
            for lo, hi in zip([0, *bounds.tolist()], [*bounds.tolist(), len(token)]):
                known = np.array([x is not None for x in held[lo:hi]])
                meet = _meetings([x and np.frombuffer(x, np.int64) for x in held[lo:hi]], token[lo]) if known.sum() > 1 else None
                for i in range(lo, hi - 1):  # sorted by size: partners end where the size is out of reach
                    j = np.arange(i + 1, lo + np.searchsorted(n[lo:hi], 100 * n[i] // percent, "right"))
                    j, c = j[root[j] != root[i]], 1
                    if len(j) and meet and known[i - lo]:
                        both, (before, shares) = known[j - lo], meet(i - lo)
                        least = -(-percent * (n[i] + n[j]) // (100 + percent)) + 1 - needed(n[j], percent)
                        c = np.where(both, shares[j - lo], 1)
                        now = ~both | ((before[j - lo] == 0) & (c >= least))
                        j, c = j[now], c[now]
                    if len(j):
                        low = cid[j] < cid[i]
                        found.append(np.stack([np.where(low, cid[j], cid[i]), np.where(low, cid[i], cid[j]), np.where(low, n[j], n[i]), np.where(low, n[i], n[j]),
                                               np.broadcast_to(c, len(j))]))
            found = np.concatenate(found, axis=1)
            pairs, at = np.unique(found[:4], axis=1, return_inverse=True)
            c = np.bincount(at.ravel(), found[4], pairs.shape[1]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*map(pa.array, pairs), pa.array(c)], names=["a", "b", "n_a", "n_b", "c"])

        yield from _runs([0, 1, 2, 3, 4], it, emit)

    def as_bytes(it):
        for b in it:
            held = [np.sort(x.values.to_numpy()).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.binary())], names=["cid", "held"])

    root = F.coalesce("root", "cid").alias("root")
    labelled = lists.join(near, F.col("cid") == F.col("node"), "left").select("token", "cid", "n", root)
    parts = labelled.groupBy("token", "root").agg(F.count("*").alias("own"))
    mixed = parts.join(parts.groupBy("token").agg(F.sum("own").alias("all")).where("all > 1"), "token").where("all > own")
    labelled = written(labelled.join(mixed.select("token", "root", (F.col("all") - F.col("own")).alias("others")), ["token", "root"]), "join-mixed")
    crowded = (labelled.groupBy("cid").agg(F.sum("others").alias("others"), F.count("*").alias("size"))
               .where((F.col("others") >= CROWD) & (F.col("size") <= CARRIED)).select("cid"))
    carried = (labelled.join(crowded, "cid").groupBy("cid").agg(F.collect_list("token").alias("held"))
               .mapInArrow(as_bytes, "cid long, held binary"))
    rest = (labelled.join(carried, "cid", "left").select("token", "cid", "n", "root", "held")
            .repartition("token").sortWithinPartitions("token", "n", "cid").mapInArrow(across, "a long, b long, n_a long, n_b long, c long"))
    rest = written(_enough(rest, percent).join(stars, ["a", "b"], "left_anti"), "join-pairs")
    more = _verified(rest, classes, docs, words, percent)
    root_of = components(links.unionByName(more))
    owned = rows.select("doc_id", "n", "cid").join(root_of, F.col("cid") == F.col("node"), "left").select("doc_id", "n", "cid", F.coalesce("root", "cid").alias("root"))
    least = owned.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return (owned.join(least, "root", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


