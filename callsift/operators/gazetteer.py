"""Preferred locations from a place table of any size.

``rules`` finds its twenty places by one regular expression; a country's place names do not fit one.  Here the turns
that may name a preferred location (the same turns as in R4) are cut into words, every run of up to as
many words as the longest name is looked up by an equi-join, and of overlapping names in a turn the leftmost, then the longest,
stands.  The table may be broadcast or shuffled as its measured size asks; a place that very many calls name is one
row on its side, and Spark splits the other side where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import TURN_RE
from .rules import AGREE_RE, GAZETTEER, NOT_HERE_RE


def builtin_places(spark) -> DataFrame:
    """The twenty places of the rules as a table (name)."""
    return spark.createDataFrame([(g,) for g in GAZETTEER], "name string")


def _key(name: Column) -> Column:
    """Words of a name in lower case, one blank between them."""
    return F.array_join(F.regexp_extract_all(F.lower(name), F.lit(r"\w+"), 0), " ")


def location_turns(calls: DataFrame, transcript: str = "transcript") -> DataFrame:
    """call_id, turn, text (lower case): Lead turns, and questions of the Agent that the next Lead turn agrees to; not
    where that Lead turn says that the place is a work place or too far."""
    turns = F.filter(F.transform(F.split(F.col(transcript), "\n", -1), lambda x, i: F.struct(
        i.alias("at"), F.regexp_extract(x, TURN_RE, 6).alias("who"), F.lower(F.regexp_extract(x, TURN_RE, 7)).alias("text"))), lambda t: t["who"] != "")
    d = calls.select("call_id", turns.alias("_turns"))
    after = lambda t: F.try_element_at(F.filter("_turns", lambda y: (y["at"] > t["at"]) & (y["who"] == "Lead")), F.lit(1))["text"]
    lead = lambda t: (t["who"] == "Lead") & ~t["text"].rlike(NOT_HERE_RE)
    asked = lambda t: (t["who"] == "Agent") & t["text"].contains("?") & F.coalesce(after(t).rlike(AGREE_RE) & ~after(t).rlike(NOT_HERE_RE), F.lit(False))
    rows = d.select("call_id", F.explode(F.filter("_turns", lambda t: lead(t) | asked(t))).alias("t"))
    return rows.select("call_id", F.col("t.at").alias("turn"), F.col("t.text").alias("text"))


def named_places(turns: DataFrame, places: DataFrame) -> DataFrame:
    """call_id, turn, name for every place that a turn (call_id, turn, text) names.

    ``places``: name; names of the same words are one place, under the smallest spelling.
    """
    table = places.select(_key(F.col("name")).alias("gram"), "name").where("gram <> ''").groupBy("gram").agg(F.min("name").alias("name"))
    longest = table.agg(F.coalesce(F.max(F.size(F.split("gram", " "))), F.lit(1))).first()[0]  # one number
    # a name does not run over punctuation
    parts = turns.select("call_id", "turn", F.posexplode(F.split("text", r"[^\w ]+")).alias("part", "text"))
    words = parts.select("call_id", "turn", "part", F.regexp_extract_all("text", F.lit(r"\w+"), 0).alias("words")).where(F.size("words") > 0)
    starts = words.select("call_id", "turn", "part", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("start"))
    last = F.least(F.lit(longest), F.size("words") - F.col("start") + 1)
    grams = starts.select("call_id", "turn", "part", "start", F.explode(F.transform(F.sequence(F.lit(1), last), lambda n: F.struct(
        n.alias("n"), F.array_join(F.slice("words", F.col("start"), n), " ").alias("gram")))).alias("g")).select("call_id", "turn", "part", "start", "g.*")
    hits = grams.join(table, "gram").groupBy("call_id", "turn", "part").agg(  # the hits of one part of one turn
        F.array_sort(F.collect_list(F.struct("start", (-F.col("n")).alias("minus"), "name"))).alias("hits"))
    empty = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("names"))
    walked = F.aggregate("hits", empty, lambda a, h: F.when(h["start"] > a["end"], F.struct(
        (h["start"] - h["minus"] - 1).alias("end"), F.concat(a["names"], F.array(h["name"])).alias("names"))).otherwise(a))
    return hits.select("call_id", "turn", F.explode(walked["names"]).alias("name"))


def locations(calls: DataFrame, places: DataFrame, transcript: str = "transcript") -> DataFrame:
    """call_id, preferred_locations (distinct, sorted; empty where a call names none)."""
    found = named_places(location_turns(calls, transcript), places).groupBy("call_id").agg(F.array_sort(F.collect_set("name")).alias("found"))
    return calls.select("call_id").join(found, "call_id", "left").select("call_id", F.coalesce("found", F.array().cast("array<string>")).alias("preferred_locations"))
