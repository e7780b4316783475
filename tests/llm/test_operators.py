"""The training-data operators against brute force, on small tables with awkward rows."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from callsift.llm import components, decontam, jaccard, langid, line_dedup, lm_score, packing, pivot_index, quality, repair, token_counts

LINE = "a long line that many documents hold in just this form"
TEXTS = [(1, "the cat sat on the mat and looked at the dog " * 8), (2, "the cat sat on the mat and looked at the dog " * 8),
         (3, None), (4, ""), (5, f"first words here\n{LINE}\nand more 12 of it"), (6, f"{LINE}\nother text of number six"),
         (7, "zażółć gęślą jaźń Straße naïve <|endoftext|> it's 42% off!!"), (8, " \t\n "), (9, "word " * 5000), (None, "a row without an id"),
         (5, f"first words here\n{LINE}\nand more 12 of it")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "x") for i, t in TEXTS], "doc_id long, text string, lang string, n string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def ids_of(text, end):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_lm_score(docs, empty):
    rows = lm_score.ppm_scores(docs).collect()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(i, [*lm_score.word_split((t or "").encode()), None]) for i, t in TEXTS]
    c = collections.Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, len(ws), sum(c[w] > 0 for w in ws), round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows) == want
    assert {r.train_tokens for r in rows} == {n} and all(r.score < 0 and r.held_out == out(r.doc_id) for r in rows)
    assert lm_score.ppm_scores(empty).count() == 0


def test_code_lengths_sum_to_one():
    g, size = lm_score.grams(lm_score._units([b"the", b"then", b"there", b"other", b"   th the ", b"   th then"]))
    u, n = np.unique(g, return_counts=True)
    low, at = np.unique(u & 0xFFFF, return_inverse=True)
    low_n = np.bincount(at, n)
    for ctx in np.unique(u >> 8)[:20]:
        symbols = np.array([b for b in range(256) if b == 32 or b not in (9, 10, 11, 12, 13)])
        every = (ctx << 8) | symbols
        count = np.array([n[np.searchsorted(u, x)] if x in u else 0 for x in every])
        rest = ~np.isin(u, every)
        p = lm_score.code_lengths(np.concatenate([every, u[rest]]), np.concatenate([count, n[rest]]), low, low_n)[:len(every)]
        assert abs((10 ** p).sum() - 1) < 1e-9


def test_packing(docs, empty):
    rows = packing.packed(docs, capacity=64).collect()
    want = sorted((k, len(p), crc(p)) for _, t in TEXTS for ids in [ids_of(t, 0)] for k, p in enumerate(ids[j:j + 64] for j in range(0, len(ids), 64)))
    assert sorted((r.piece, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed(empty).count() == 0


def test_best_two_fit_beats_greedy():
    assert sorted(map(sorted, packing.pack([6, 3, 5, 5, 4, 4, 3], 10))) and len(packing.pack([6, 3, 5, 5, 4, 4, 3], 10)) == 3
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 3000).tolist()
    rows = packing.pack(lengths, 2048)
    assert sorted(i for r in rows for i in r) == list(range(3000)) and len(rows) <= 1.01 * sum(lengths) / 2048 + 2


def test_line_dedup(docs, empty):
    got = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    assert (5, TEXTS[4][1]) in got and (6, "other text of number six") in got and (2, "") in got and (1, TEXTS[0][1]) in got
    assert line_dedup.dedup_lines(docs).count() == len(TEXTS) and line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_rows_that_share_an_id(spark):
    rows = [(1, f"{LINE}\nown text of the first"), (None, f"{LINE}\nsecond line of one row"), (None, "only in this row\nand this too"), (None, None),
            (7, f"kept start\n{LINE}"), (7, "other start\nother end")]
    got = {(r.doc_id, r.text, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, rows[0][1], 0), (None, "second line of one row", 1), (None, rows[2][1], 0), (None, None, 0), (7, "kept start", 1), (7, rows[5][1], 0)}


def plain_line_dedup(rows):
    """The rule of line_dedup over (doc_id, text) rows with distinct ids: doc_id -> kept lines."""
    lines = [(d, at, line, re.sub(" +", " ", re.sub("[^ ]*[0-9][^ ]*", "<*>", line)).strip(" ").split(" "))
             for d, t in rows for at, line in enumerate(t.split("\n"))]
    place = {}
    for d, at, _, w in sorted(lines, key=lambda x: x[:2]):
        if len(w) >= 6 or len(" ".join(w)) >= 40:
            place.setdefault(tuple(w), (d, at))
    first = {w: p[0] for w, p in place.items()}
    centre = {}

    def nodes(w):
        n, k = len(w), len(w) * 30 // 100 + 1
        return [(n, w[:3], j, w[3 + j * (n - 3) // k:3 + (j + 1) * (n - 3) // k]) for j in range(k)] if n >= 6 else []

    for w in sorted(place, key=place.get):
        for node in nodes(w):
            centre.setdefault(node, w)
    for w in place:
        for c in (centre[node] for node in nodes(w)):
            if 100 * sum(a != b for a, b in zip(w, c)) <= 30 * len(w):
                first[w] = min(first[w], place[c][0])
    kept = {d: [] for d, _ in rows}
    for d, _, line, w in lines:
        if first.get(tuple(w), d) >= d:
            kept[d].append(line)
    return kept


def test_line_dedup_generalises_inside_a_leaf(spark):
    rnd = random.Random(5)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    base = [[rnd.choice(words) for _ in range(n)] for n in (6, 7, 9, 14, 30, 30) for _ in range(3)]
    rows = []
    for d in range(120):
        text = []
        for _ in range(rnd.randint(1, 4)):
            w = list(rnd.choice(base))
            for i in rnd.sample(range(len(w)), rnd.randint(0, len(w) // 2)):
                w[i] = rnd.choice([*words, "4711"])
            text.append(" ".join(w))
        rows.append((d, "\n".join(text)))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_line_dedup(rows)
    assert got == {d: "\n".join(x) for d, x in want.items()}
    equal = collections.Counter(line for _, t in rows for line in t.split("\n"))
    assert sum(len(x) for x in want.values()) < len(equal)  # more goes than equal lines


def test_line_dedup_cases(spark):
    long_line, solid = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(15_000)), "x" * 50
    rows = [(1, f"At noon the user Alice opened the door today\n{long_line}\n{solid}\nshort line", "a"),
            (2, f"At noon the user Bob opened the door today\n{long_line} end\n{solid}\nshort line", "b"),
            (3, "The user Bob shut a window before three yesterday", "c"), (3, "The user Bob shut a window before three yesterday", "c")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_lines string"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect())
    assert got == [(1, rows[0][1], 4, 0), (2, f"{long_line} end\nshort line", 4, 2), (3, rows[2][1], 1, 0), (3, rows[2][1], 1, 0)]


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base, base[:10] + 0.05 * rng.normal(size=(10, 16)), np.tile(base[20] * 2, (30, 1))])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] * 16, 1), (103, base[0].tolist(), None), (104, [1.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pivot_index.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.arange(80)[:, None] % 2 == np.arange(80)[None] % 2) & ~np.eye(80, dtype=bool)
    root = list(range(80))
    for _ in range(80):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(80)]
    for i in range(80):
        assert got[i] == (near[i].sum(), root[i], root[i] == i)
    assert all(got[i] == (0, i, True) for i in range(100, 105))


def test_near_vectors_of_a_hot_group(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(12000, 64))
    x[:4000] = rng.normal(size=64) + 0.23 * x[:4000]  # a third of the vectors is a group of unequal near copies
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = np.concatenate([(u[i:i + 1000] @ u.T >= 0.93).sum(1) - 1 for i in range(0, 12000, 1000)])
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(8)
    got = {r.vec_id: r.n_links for r in pivot_index.near_duplicates(rows).collect()}
    assert [got[i] for i in range(12000)] == want.tolist() and want.sum() // 2 == 7_899_665


def test_quality(spark, docs, empty):
    rows = [(i, "plain words in a row " * 20 if i % 2 else "x### y$$$ z%%% " * 20) for i in range(200)] + [(None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.quality_scores(d, labels).collect()
    assert len(got) == 201 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None)
    assert quality.quality_scores(docs, labels.limit(0)).count() == len(TEXTS) and quality.quality_scores(empty, labels).count() == 0


def test_token_counts(docs, empty):
    p = token_counts.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = sorted({w.encode() for _, t in TEXTS for w in (t or "").split()})
    marked = sorted(token_counts.MARK + w for w in words)
    assert p.counts(marked).tolist() == [p.count(w) for w in marked]
    got = sorted((r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(docs).collect())
    assert got == sorted((len((t or "").encode().split()), sum(p.count(token_counts.MARK + w) for w in (t or "").encode().split())) for _, t in TEXTS)
    assert token_counts.token_counts(empty).count() == 0


def test_languages(spark, docs):
    rows = [(i, ("the house and the garden of that man " if i % 2 else "das Haus und der Garten von dem Mann ") * 5, "en" if i % 2 else "de") for i in range(80)]
    d = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !!", None), (902, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.languages(d).collect()}
    assert all(got[i][0] == x for i, _, x in rows) and all(got[i] == ("und", 0.0) for i in (900, 901, 902))
    model = langid.train(d)
    langid.prepare(spark)
    assert [x for _, _, x in langid.spans(model, rows[0][1] + rows[1][1])] == ["de", "en"]
    assert {r.lang_pred for r in langid.languages(docs.limit(0).union(docs.where("text is null"))).collect()} == {"und"}


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(3)
    size = np.array([0, 5, 1, 7])
    s = -12 * rng.random((13, 3))
    got, at = langid.viterbi(s, size), 0
    for n in size:
        def cost(path):
            return sum(s[at + i, x] for i, x in enumerate(path)) - langid.SWITCH * sum(a != b for a, b in zip(path, path[1:]))
        best = max(map(cost, np.ndindex(*[3] * n)), default=0)
        assert abs(cost(got[at:at + n].tolist()) - best) < 1e-9
        at += n


def test_decontamination(spark, docs, empty):
    item = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (1, item)], "item_id long, text string")
    rows = [(1, f"before it {item.upper()}, and after"), (2, item.replace("w29", "other")), (3, " ".join(item.split()[:15])), (4, None), (5, ""), (None, item), (1, f"before it {item.upper()}, and after")]
    got = {(r.doc_id, r.item_id, round(r.similarity, 4)) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1, 1.0), (2, 1, round(25 / 27, 4))}
    assert decontam.contaminated(empty, items).count() == 0 and decontam.clean(docs, items).count() == len(TEXTS)


def test_decontamination_of_moved_and_missing_words(spark):
    w = [f"w{i}" for i in range(100)]
    other = "another item of quite different words that has the same id as the first one"
    items = spark.createDataFrame([(1, " ".join(w)), (1, other)], "item_id long, text string")
    rows = [(1, " ".join(w[:-1])), (2, " ".join(w[:-5])), (3, " ".join([*"abcdef", *w[50:], *w[:50], *"ghijkl"])),
            (4, " ".join([*"abcdef", *w[20:], *w[:20], *"ghijkl"])), (5, f"before {other} after"), (6, " ".join(w[:60]))]
    got = {(r.doc_id, round(r.similarity, 4), r.start_word) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, round(95 / 96, 4), 0), (2, round(91 / 96, 4), 0), (3, round(92 / 100, 4), 6), (4, round(92 / 100, 4), 6), (5, 1.0, 1)}


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return {(i, len(sets[i]), root[i]) for i in sets}


def test_ngram_join(spark, docs, empty):
    rng = np.random.default_rng(4)
    base = [f"v{x}" for x in rng.integers(0, 500, 120)]
    texts = [(i, " ".join("edit" if j in rng.choice(120, i % 5, False) else w for j, w in enumerate(base))) for i in range(60)]
    texts += [(100 + i, t) for i, t in enumerate(["", None, "one two", "One two", "one two three", " "])]
    got = jaccard.ngram_join(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_components(texts)
    assert jaccard.ngram_join(docs).count() == len(TEXTS) and jaccard.ngram_join(empty).count() == 0


def test_near_duplicate_stage_takes_five_words(spark):
    import corpus_pipeline

    w = [f"v{i}" for i in range(50)]  # one word changed: 41/51 of the 5-word and 43/51 of the 4-word shingles
    rows = [(1, " ".join(w)), (2, " ".join([*w[:25], "edit", *w[26:]])), (3, "some other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}
    assert {r.component_id for r in jaccard.ngram_join(docs).collect()} == {1, 2, 3}


def test_stages_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    a, b, item = (" ".join(f"{x}{i}" for i in range(40)) for x in "abi")
    rows = [(7, a), (3, a), (None, a), (None, b), (None, b), (5, "c " + item), (5, "c " + item), (None, f"d {item} e"), (None, ""), (8, None), (9, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert order(got) == sorted([(3, a), (None, b), (5, "c " + item), (None, ""), (8, None), (9, "other text")], key=str)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert order(corpus_pipeline.decontaminate(spark, docs, str(tmp_path))) == sorted([r for r in rows if item not in (r[1] or "")], key=str)


def test_divide_skip_counts():
    rng = np.random.default_rng(5)
    q = np.unique(rng.integers(0, 400, 100))
    sets = [np.unique(np.concatenate([rng.choice(q, k, False), rng.integers(0, 400, 8)])) for k in rng.integers(40, len(q), 80)]
    want = [100 * len(np.intersect1d(q, s)) >= 85 * len(np.union1d(q, s)) for s in sets]
    assert jaccard.divide_skip(q, sets, 85).tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 30), (30, 40), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 40: 30, 50: 30}


def test_repair_files(docs, empty):
    shards = repair.write_ids(docs)
    got = sorted((r.start, r.n_tokens, r.ids_crc32) for r in repair.read_ids(shards).collect())
    at, order = 0, sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    want = []
    for _, t in order:
        ids = ids_of(t, 1)
        want.append((at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(x[1:] for x in got) == sorted(x[1:] for x in want) and sum(x[1] for x in got) == at
    assert repair.read_ids(repair.write_ids(empty)).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(6)
    ids = np.tile(rng.integers(0, 50, 40), 200).astype("<u4")
    starts = np.array([0, 3000, 5000])
    rules, symbols, at = repair.compress(ids, starts, 1000)
    assert len(symbols) < len(ids) / 4
    lengths = repair.expansion_lengths(rules, 1000)
    own = symbols[at[1]:at[2]]
    assert repair.ids_between(own, rules, lengths, 1000, 0, 2000).tolist() == ids[3000:5000].tolist()
    assert repair.ids_between(own, rules, lengths, 1000, 37, 411).tolist() == ids[3037:3411].tolist()


def test_names_and_pipeline(spark):
    import __spark_entry__ as entry
    import corpus_pipeline

    numbers = [int(m[1]) for q in entry.queries() if (m := re.match(r"op(\d+)_", q))]
    assert sorted(numbers) == list(range(1, 14)) and [n for n, _ in corpus_pipeline.STAGES][0] == "quality"
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
