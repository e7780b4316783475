"""Place table against the regular expression; search index against a full search."""

import random
import time
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from callsift.operators import gazetteer, search_index
from callsift.operators.rules import rules_analysis
from callsift.operators.views import search_predicate
from callsift.session import work_dir


def call(*lines):
    return "\n".join(f"[00:{i:02d}-00:{i + 1:02d}] {x}" for i, x in enumerate(lines))


CALLS = [("a", call("Lead: I like Anna Nagar, T Nagar or OMR", "Agent: Is Porur fine?", "Lead: yes", "Agent: And Adyar?", "Lead: no")),
         ("b", call("Lead: I work in Guindy", "Agent: what about ECR?", "Lead: okay but too far")), ("c", ""), ("d", None), ("e", "no turns at all, OMR"),
         ("f", call("Lead: omromr ecr-omr xomr", "Agent: Tambaram?")), ("g", call("Lead: anna, nagar")), ("h", call("Lead: t nagar t nagar velachery"))]


def test_place_table_equals_the_expression(spark):
    calls = spark.createDataFrame(CALLS, "call_id string, transcript string")
    many = spark.range(100_000).select(F.format_string("Place %d of nowhere", "id").alias("name"))
    got = {r.call_id: r.preferred_locations for r in gazetteer.locations(calls, gazetteer.builtin_places(spark).unionByName(many)).collect()}
    want = {r.call_id: r.l for r in rules_analysis(calls.where("transcript is not null")).select("call_id", F.col("rules.extraction.preferred_locations").alias("l")).collect()}
    assert got == want | {"d": []} and got["a"] == ["Anna Nagar", "OMR", "Porur", "T Nagar"]


def test_longest_name_wins_and_spellings_are_one_place(spark):
    places = spark.createDataFrame([("Anna Nagar",), ("Anna Nagar West",), ("anna  nagar",), ("Nagar West",), ("West End",), ("!",)], "name string")
    turns = spark.createDataFrame([("a", 0, "anna nagar west end"), ("a", 1, "nagar west and west end"), ("b", 0, "anna nagar. west end")], "call_id string, turn int, text string")
    assert sorted(map(tuple, gazetteer.named_places(turns, places).collect())) == [
        ("a", 0, "Anna Nagar West"), ("a", 1, "Nagar West"), ("a", 1, "West End"), ("b", 0, "Anna Nagar"), ("b", 0, "West End")]
    assert gazetteer.named_places(turns, places.limit(0)).count() == 0


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(8)
    words = ["Straße", "über", "50%", "a_b", "site", "VISIT", "wetter", "日本語", "x~y", "it's", "back\\slash"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 30))) + "\nend", rnd.choice(["Ann", "Bob", None])) for i in range(400)]
    rows += [(400, None, None), (401, "", "needle"), (402, "a needle in hay", ""), (403, "ab", "c")]
    return spark.createDataFrame(rows, "id int, text string, name string").repartition(3)


@pytest.mark.parametrize("block", [4, 64])
def test_index_equals_full_search(spark, texts, block, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", block)
    if block == 4:
        monkeypatch.setattr(search_index, "NAMED", 3)
    root = work_dir(spark, f"test-search-{uuid.uuid4().hex[:8]}")
    search_index.build(texts, root, ["text", "name"])
    for term in ["needle", " SITE visit ", "strasse", "straße ü", "日本語", "50%", "a_b", "a%b", "ab", "_", "x~y", "it's b", "back\\s", "needle%hay", "hay%needle", "e\nen", "no such words", " "]:
        for literal in (False, True):
            test = search_predicate(term, ["text", "name"], literal)
            want = sorted(r.id for r in (texts if test is None else texts.where(test)).collect())
            assert sorted(r.id for r in search_index.search(spark, root, term, ["text", "name"], literal).collect()) == want, (term, literal)
    # a rare term leaves most blocks out
    assert search_index.blocks(spark, root, search_index.term_runs("needle")).count() <= 2


def test_runs_of_a_block_come_once(spark):
    texts = [[b"abcabc", "a\0\0b😀日本".encode(), None, b"ab", b""], [b"bcax", None, b"", b"zz", "ééé".encode()]]
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array([7] * 3 + [8] * 2)[a:b], *[pa.array(t, pa.binary())[a:b] for t in texts]], names=["_block", "a", "b"])
    got = [(r["_block"], r["run"]) for out in search_index.block_runs(iter([batch(0, 1), batch(1, 5)])) for r in out.to_pylist()]
    plain = [(7, "abcabc"), (7, "a\0\0b😀日本"), (7, "bcax"), (8, "ééé")]
    assert sorted(got) == sorted({(b, t[i:i + 3]) for b, t in plain for i in range(len(t) - 2)})


def test_the_search_test_is_a_like_that_reads_a_text_once(spark, texts):
    for term in ["a%b", "%", "__", "s%_e%", "a_b", "it's%\\", "x~y", "(a|b)", "%e\n%", "日_語", "v%T W", "b\\s", "e%e%e%e"]:
        for literal in (False, True):
            like = term.lower().replace("~", "~~")
            like = like.replace("%", "~%").replace("_", "~_") if literal else like
            want = texts.where(F.like(F.lower("text"), F.lit(f"%{like}%"), F.lit("~")))
            assert sorted(r.id for r in texts.where(search_predicate(term, ["text"], literal)).collect()) == sorted(r.id for r in want.collect()), (term, literal)
    long = spark.range(1).select(F.repeat(F.lit("Der "), 60_000).alias("text"))
    began = time.monotonic()
    assert long.where(search_predicate("der%lich", ["text"])).count() == 0 and time.monotonic() - began < 5
