"""Display formatting of the manager console as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col_


def fmt_duration(c) -> Column:
    """Seconds as m:ss."""
    d = F.coalesce(col_(c), F.lit(0))
    return F.concat(F.floor(d / 60).cast("string"), F.lit(":"), F.lpad((d % 60).cast("string"), 2, "0"))


def fmt_date(c, zone: str = "Asia/Kolkata") -> Column:
    """Day, short month, 12-hour clock in the viewer's zone, e.g. '10 Apr, 02:32 pm' (T4)."""
    local = F.from_utc_timestamp(col_(c), zone)
    return F.concat(F.date_format(local, "d MMM, hh:mm "), F.lower(F.date_format(local, "a")))


def score_band(c) -> Column:
    """Half-up rounded score clamped to 0..5 (T5)."""
    return F.least(F.lit(5), F.greatest(F.lit(0), F.floor(F.coalesce(col_(c), F.lit(0.0)) + 0.5))).cast("int")


def js_number(c) -> Column:
    """A double printed as JavaScript prints it for the values we show: whole numbers without '.0'."""
    x = col_(c)
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def budget_label(budget) -> Column:
    """'Not discussed', '42 L' or '55–70 L' (T6)."""
    b = col_(budget)
    lo, hi = b["min_lakhs"], b["max_lakhs"]
    return (F.when(b.isNull(), F.lit("Not discussed"))
            .when(lo == hi, F.concat(js_number(lo), F.lit(" L")))
            .otherwise(F.concat(js_number(lo), F.lit("–"), js_number(hi), F.lit(" L"))))


def locations_label(c) -> Column:
    """Locations joined with ', ', or 'None' (T7)."""
    a = col_(c)
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.array_join(a, ", ")).otherwise(F.lit("None"))


def tenths_text(tenths) -> Column:
    t = col_(tenths)
    return F.concat((t.cast("long") / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def quarters_one_decimal(quarters) -> Column:
    """toFixed(1) of a per-call overall score held as integer quarters.

    The score is q/4; JavaScript's toFixed rounds exact ties up, which on
    quarters is (20q + 4) div 8 tenths.
    """
    q = F.coalesce(col_(quarters), F.lit(0)).cast("long")
    return tenths_text(F.floor((q * 20 + 4) / 8).cast("long"))


def quarters_two_decimals(quarters) -> Column:
    """toFixed(2) of q/4: quarters are exact in two decimals."""
    q = F.coalesce(col_(quarters), F.lit(0)).cast("long")
    hundredths = q * 25
    return F.concat(F.floor(hundredths / 100).cast("long").cast("string"), F.lit("."),
                    F.lpad((hundredths % 100).cast("string"), 2, "0"))


def dimension_label(c) -> Column:
    """Underscores to spaces."""
    return F.translate(col_(c), "_", " ")
