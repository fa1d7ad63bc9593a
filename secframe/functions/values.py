"""Small Column helpers shared by ingest and rules."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from secframe.schema import PLACEHOLDERS


def clean(c: Column) -> Column:
    """Vendor spellings of 'no value' become null."""
    return F.when(~F.trim(c).isin(PLACEHOLDERS), c)


def first_of(*cols: Column) -> Column:
    return F.coalesce(*[clean(c) for c in cols])


def basename(c: Column) -> Column:
    """Last path component, lower-case, for either slash."""
    flat = F.rtrim(F.translate(c, "/", "\\"), F.lit("\\"))
    return F.lower(F.substring_index(flat, "\\", -1))


def basename_if_path(c: Column) -> Column:
    return F.when(c.contains("\\") | c.contains("/"), basename(c)).otherwise(c)


def to_long(c: Column) -> Column:
    text = F.trim(c)
    return F.coalesce(text.try_cast("bigint"), F.floor(text.try_cast("double")).cast("bigint"))


def any_of(preds) -> Column:
    preds = list(preds)
    return reduce(lambda a, b: a | b, preds) if preds else F.lit(False)


def all_of(preds) -> Column:
    preds = list(preds)
    return reduce(lambda a, b: a & b, preds) if preds else F.lit(True)


def floor_div(num: Column, den) -> Column:
    """Exact floor division of bigints (no detour through double)."""
    den = den if isinstance(den, Column) else F.lit(den)
    rest = F.pmod(num, den)
    return F.call_function("div", num - rest, den)


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp column."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c)
