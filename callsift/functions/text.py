"""Transcript text functions: strip, content hash, turns, duration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Python's str.strip() removes every character for which str.isspace() is true:
# ASCII whitespace, the information separators \x1c-\x1f, NEL and the Unicode
# space separators.  Java's \s is ASCII-only, so the class is spelled out.
PY_SPACE = r"[\t\n\x0B\f\r \x1c-\x1f\x85\p{Z}]"
# The characters of that class, for a trim that looks at the ends of a text only.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# Transcript line: "[MM:SS-MM:SS] Agent: text" (fixed format of the call records)
TURN_RE = r"^(\[(\d+):(\d+)-(\d+):(\d+)\])\s*(Agent|Lead):\s*(.*)$"
# Any "[M:S-M:S]" stamp; the last one gives the duration estimate
STAMP_RE = r"\[(\d+):(\d+)-(\d+):(\d+)\]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pystrip(c) -> Column:
    """str.strip() with Python's notion of whitespace."""
    return F.btrim(col_(c), F.lit(_SPACES))


def pystrip_long(c) -> Column:
    """``pystrip`` of a column of long texts: a trim lays out every character, so only texts with white space at an end are trimmed."""
    t = col_(c)
    blank_end = F.lit(_SPACES).contains(F.left(t, F.lit(1))) | F.lit(_SPACES).contains(F.right(t, F.lit(1)))
    return F.when(blank_end, pystrip(t)).otherwise(t)


def blank_to_null(c) -> Column:
    """NULL when the stripped text is empty, else the stripped text."""
    s = pystrip(c)
    return F.when(s != "", s)


def transcript_hash(c) -> Column:
    """First 32 hex chars of SHA-256 over the stripped UTF-8 text."""
    return F.substring(F.sha2(pystrip(c), 256), 1, 32)


def duration_from_transcript(c) -> Column:
    """Seconds of the end part of the last [MM:SS-MM:SS] stamp; 0 when none."""
    t = col_(c)
    mins = F.try_element_at(F.regexp_extract_all(t, F.lit(STAMP_RE), 3), F.lit(-1))
    secs = F.try_element_at(F.regexp_extract_all(t, F.lit(STAMP_RE), 4), F.lit(-1))
    # try_ arithmetic: an absurd stamp gives NULL (then 0) instead of failing the query under ANSI
    d = F.try_add(F.try_multiply(mins.try_cast("bigint"), F.lit(60).cast("bigint")), secs.try_cast("bigint"))
    return F.coalesce(d, F.lit(0).cast("bigint"))


def explode_turns(df: DataFrame, key: str = "call_id", text: str = "transcript") -> DataFrame:
    """One row per transcript line.

    Lines that do not match the "[MM:SS-MM:SS] Agent|Lead: text" form pass
    through with ``parsed = false`` and NULL speaker, as the viewer shows them
    verbatim.  The explode is a narrow, per-row operation: no shuffle.
    """
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("turn_no", "line"))
    m = lambda i: F.regexp_extract("line", TURN_RE, i)
    parsed = F.col("line").rlike(TURN_RE)
    return lines.select(
        key, F.col("turn_no").cast("int").alias("turn_no"), "line",
        parsed.alias("parsed"),
        F.when(parsed, m(1)).alias("stamp"),
        F.when(parsed, F.try_add(F.try_multiply(m(2).try_cast("int"), F.lit(60)), m(3).try_cast("int"))).alias("start_sec"),
        F.when(parsed, F.try_add(F.try_multiply(m(4).try_cast("int"), F.lit(60)), m(5).try_cast("int"))).alias("end_sec"),
        F.when(parsed, m(6)).alias("speaker"),
        F.when(parsed, m(7)).alias("utterance"),
    )


def parsed_turns(text: str = "transcript") -> Column:
    """The lines of a transcript as an array of (line, parsed, stamp, speaker, utterance), as ``explode_turns`` gives them in rows."""
    m = lambda x, i: F.regexp_extract(x, TURN_RE, i)

    def turn(x: Column) -> Column:
        ok = x.rlike(TURN_RE)
        return F.struct(x.alias("line"), ok.alias("parsed"), F.when(ok, m(x, 1)).alias("stamp"), F.when(ok, m(x, 6)).alias("speaker"), F.when(ok, m(x, 7)).alias("utterance"))

    return F.transform(F.split(F.col(text), "\n", -1), turn)
