"""Line deduplication by a log-template tree, in DataFrame functions only.

A line's template is its words with the variable fields (every word with a digit:
numbers, dates, ids, addresses) as ``<*>``.  The tree has a fixed depth: the count of
words, then the first ``LEAD`` words of the template; a leaf holds templates.  Inside a
leaf, templates that differ in at most ``VARIED`` percent of their positions are one: the
positions that differ are variable fields as well.  The words behind the leading ones are
cut into one block more than positions may differ, so two such templates agree in a whole
block.  The templates of a leaf that agree in a block are a node, whose centre is the
one seen first (smallest doc_id, then line); every template is compared with the centres of its
nodes, never with all others, and takes the first document of each centre it matches.  Two templates
that match each other but no centre stay apart.

A line counts when its template has ``MIN_WORDS`` words or ``MIN_CHARS`` characters
(long lines without spaces); only those with ``MIN_WORDS`` words are generalised.  A template
that occurs in more than one document, itself or through a centre, is recurring: it
stays in the document with the smallest doc_id and its lines are dropped from all others.
Repeats within one document are left alone.

A template's first document is a grouped minimum, combined before the shuffle, so a line
that a third of all documents hold sends a row per task.  Texts are shuffled to compare words
only where they hold the first line of a template in a leaf of several (a table of 8 MB of hashed cells keeps
the other texts back; with more than some 10^8 such texts it keeps back less, the result is the same).  A leaf, node or template that is hot
in a join is one row on the other side, so AQE can split it.  Marked lines are kept by (doc_id, hash of the text): rows that share an id, or have none, lose only lines of their own.

Nulls: a null text stays null; a null doc_id comes after all others.  Empty texts have
one empty line.  Rows with the same doc_id are one document; rows that repeat have the same lines
dropped.  A very long text or line is worked on whole.  Other columns pass through; columns of
``docs`` named n_lines or n_dropped are replaced.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LEAD, MIN_WORDS, MIN_CHARS, VARIED = 3, 6, 40, 30
_LAST = (1 << 63) - 1
_TREE = ["n", "leaf", "h"]


def template(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ ]*[0-9][^ ]*", "<*>")).otherwise(line)
    return F.trim(F.when(masked.contains("  "), F.regexp_replace(masked, " +", " ")).otherwise(masked))


def marks(keys: DataFrame, on: list[str]) -> DataFrame:
    """The keys as set bits of 2^26 hashed cells: (__part, __bits) in at most 2,048 rows of 4 KB."""
    cell = F.pmod(F.xxhash64(*on), F.lit(1 << 26))
    cells = keys.select(F.shiftright(cell, 15).alias("__part"), cell.bitwiseAND(32767).alias("__bit"))
    return cells.groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))


def marked(rows: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose cell is set, without a shuffle: all that have a key in ``marks`` and a few more."""
    cell = F.pmod(F.xxhash64(*on), F.lit(1 << 26))
    rows = rows.withColumn("__part", F.shiftright(cell, 15)).join(F.broadcast(cells), "__part")
    bit = cell.bitwiseAND(32767).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return rows.where(F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1).drop("__part", "__bits")


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` keyed by document and text hash; rows without text are left out."""
    return docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("body"), "text")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("d", "body", *(c for c in docs.columns if c == "wanted"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))


def _templates(lines: DataFrame) -> DataFrame:
    """Document, text hash, line number, template and its place in the tree."""
    lines = lines.select("d", "body", "at", template(F.col("line")).alias("t"))
    count = F.length("t") - F.length(F.replace("t", F.lit(" "), F.lit(""))) + 1
    return lines.select("d", "body", "at", "t", count.alias("n"), F.xxhash64(F.substring_index("t", " ", LEAD)).alias("leaf"), F.xxhash64("t").alias("h"))


def _centres(docs: DataFrame, lines: DataFrame, templates: DataFrame, min_words: int, varied: int) -> DataFrame:
    """(n, leaf, h, low): the first document of the centres that a template matches; templates that match none are missing."""
    able = templates.where(F.col("n") >= max(min_words, 2 * LEAD))
    leaves = able.groupBy("n", "leaf").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    place = [*_TREE, "d"]
    able = able.join(leaves, ["n", "leaf"]).select(*_TREE, F.col("first").alias("d"))
    able = written(lines.join(able, place).groupBy(place).agg(F.min(F.struct("at", "body")).alias("x")).select(*place, "x.*"), "leaf-templates")
    text = ["d", "body"]
    wanted = able.groupBy(text).agg(F.collect_set("at").alias("wanted"))
    found = marked(_placed(docs), marks(able, text), text).join(wanted, text)
    found = _templates(_lines(found).where(F.array_contains("wanted", F.col("at"))))
    words = F.transform(F.split("t", " "), lambda w: F.xxhash64(w))
    able = found.groupBy(place).agg(F.min("at").alias("at"), F.first("t").alias("t"))
    able = written(able.select(*place, "at", words.alias("words")), "leaf-words")
    rest = F.col("n") - LEAD
    parts = F.floor(F.col("n") * varied / 100).cast("int") + 1
    start = lambda j: F.floor(j * rest / parts).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.xxhash64("n", j, F.slice("words", start(j) + LEAD + 1, start(j + 1) - start(j))))
    blocks = able.select(*place, "at", F.explode(blocks).alias("block"))
    nodes = blocks.groupBy("leaf", "block").agg(F.count("*").alias("c"), F.min(F.struct("d", "at", "h")).alias("centre"))
    nodes = written(nodes.where("c > 1").select("leaf", "block", F.col("centre.h").alias("centre")), "leaf-nodes")
    pairs = blocks.select(*_TREE, "block").join(nodes, ["leaf", "block"]).where("h <> centre").select(*_TREE, "centre").distinct()
    pairs = pairs.join(able.select(*_TREE, "words"), _TREE)
    centres = able.select("n", "leaf", F.col("h").alias("centre"), F.col("d").alias("low"), F.col("words").alias("other"))
    centres = centres.join(nodes.select("leaf", "centre").distinct(), ["leaf", "centre"], "left_semi")
    pairs = pairs.join(centres, ["n", "leaf", "centre"])
    differ = F.size(F.filter(F.zip_with("words", "other", lambda a, b: a != b), lambda x: x))
    return pairs.where(100 * differ <= varied * F.col("n")).groupBy(_TREE).agg(F.min("low").alias("low"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS, varied: int = VARIED) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the kept lines as text, and the columns n_lines and n_dropped."""
    lines = _templates(_lines(_placed(docs))).where((F.col("n") >= min_words) | (F.length("t") >= min_chars))
    lines = written(lines.drop("t"), "line-templates")
    templates = written(lines.groupBy(_TREE).agg(F.min("d").alias("first"), F.max("d").alias("last")), "templates")
    found = _centres(docs, lines, templates, min_words, varied)
    first = templates.join(found, _TREE, "left").withColumn("first", F.least("first", "low")).where("first < last").select(*_TREE, "first")
    drop = lines.join(first, _TREE).where("d > first").groupBy("d", "body").agg(F.collect_set("at").alias("__drop"))
    drop = drop.withColumnsRenamed({"d": "__d", "body": "__body"})
    key, body = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64("text")
    rows = docs.join(drop, (key == F.col("__d")) & (body == F.col("__body")), "left").withColumn("__lines", F.split("text", "\n", -1))
    some = F.col("__drop").isNotNull() & F.col("text").isNotNull()
    rows = rows.withColumn("__kept", F.when(some, F.filter("__lines", lambda x, i: ~F.array_contains("__drop", i))))
    out = {c: F.col(c) for c in docs.columns} | {
        "text": F.when(some, F.array_join("__kept", "\n")).otherwise(F.col("text")),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long"),
        "n_dropped": F.when(some, F.size("__lines") - F.size("__kept")).otherwise(0).cast("long")}
    return rows.select(*(c.alias(name) for name, c in out.items()))


ORACLE = f"""
WITH lines AS MATERIALIZED (
  SELECT doc_id, coalesce(doc_id, {_LAST}) AS d, u.i - 1 AS pos, u.line,
         trim(regexp_replace(regexp_replace(u.line, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' +', ' ', 'g'), ' ') AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) s,
       LATERAL (SELECT unnest(s.l) AS line, generate_subscripts(s.l, 1) AS i) u),
templates AS MATERIALIZED (
  SELECT t, string_split(t, ' ') AS w, len(string_split(t, ' ')) AS n, min(d) AS first, min(struct_pack(d := d, pos := pos)) AS place
  FROM lines WHERE len(string_split(t, ' ')) >= {MIN_WORDS} OR length(t) >= {MIN_CHARS} GROUP BY t),
parts AS (
  SELECT t, w, n, place, first, w[1:{LEAD}] AS lead, n - {LEAD} AS rest, n * {VARIED} // 100 + 1 AS k,
         unnest(range(n * {VARIED} // 100 + 1)) AS j
  FROM templates WHERE n >= {MIN_WORDS}),
blocks AS MATERIALIZED (
  SELECT t, w, n, place, first, lead, j, w[{LEAD} + 1 + j * rest // k : {LEAD} + (j + 1) * rest // k] AS block FROM parts),
nodes AS (
  SELECT n, lead, j, block, min(place) AS place, min_by(w, place) AS w, min_by(first, place) AS first
  FROM blocks GROUP BY n, lead, j, block HAVING count(*) > 1),
matched AS (
  SELECT b.t, min(c.first) AS low
  FROM blocks b JOIN nodes c ON b.n = c.n AND b.lead = c.lead AND b.j = c.j AND b.block = c.block
  WHERE 100 * len(list_filter(range(1, b.n + 1), lambda i: b.w[i] <> c.w[i])) <= {VARIED} * b.n GROUP BY b.t),
marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(least(f.first, coalesce(m.low, f.first)) < l.d, false) AS gone
  FROM lines l LEFT JOIN templates f ON l.t = f.t LEFT JOIN matched m ON l.t = m.t)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_md5
FROM marked GROUP BY doc_id
"""
