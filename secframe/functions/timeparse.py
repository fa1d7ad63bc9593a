"""Timestamp normalization (whole UTC seconds) for the log shapes ingest meets.

The shape is decided by one regex per family and only the matching parser runs, instead of
trying every pattern in turn on every row.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: accepted shapes
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})?$"
SPACED = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
RFC = r"^[A-Z][a-z]{2}, \d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}( (Z|[+-]\d{2}:?\d{2}))?$"
APACHE = r"^\d{1,2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}( (Z|[+-]\d{2}:?\d{2}))?$"
BRACKETED = r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}) [^\]]*\]"
SYSLOG = r"^[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}$"
_ZONE = r"([+-]\d{2}):?(\d{2})$"


def _zoned(c: Column, glue: str) -> Column:
    """Give every value an explicit offset so the session time zone never matters."""
    colon = F.regexp_replace(c, _ZONE, "$1:$2")
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), colon).otherwise(F.concat(c, F.lit(glue)))


def parse_timestamp(raw: Column, year: int = 2026, offset: str = "+00:00",
                    expect: str | None = None) -> Column:
    """UTC timestamp truncated to seconds, or null.

    ``year`` and ``offset`` fill in what syslog headers lack; other naive values are UTC.
    ``expect`` names the shape to test first (``apache`` or ``syslog``); the rest still apply.
    """
    s = F.trim(raw)
    rfc = F.regexp_replace(s, r"^[A-Z][a-z]{2}, ", "")
    squeezed = F.regexp_replace(s, r" +", " ")
    at = lambda text, pattern: F.try_to_timestamp(text, F.lit(pattern))
    bracketed = F.concat(F.regexp_extract(s, BRACKETED, 1), F.lit(" +00:00"))
    shapes = {
        "iso": (ISO, _zoned(s, "+00:00").try_cast("timestamp")),
        "spaced": (SPACED, F.concat(F.translate(s, " ", "T"), F.lit("+00:00")).try_cast("timestamp")),
        "rfc": (RFC, at(_zoned(rfc, " +00:00"), "d MMM yyyy HH:mm:ss XXX")),
        "apache": (APACHE, at(_zoned(s, " +00:00"), "d/MMM/yyyy:HH:mm:ss XXX")),
        "bracketed": (BRACKETED, at(bracketed, "dd/MMM/yyyy:HH:mm:ss XXX")),
        "syslog": (SYSLOG, at(F.concat(F.lit(f"{year} "), squeezed, F.lit(f" {offset}")),
                              "yyyy MMM d HH:mm:ss XXX")),
    }
    parsed = None
    for name in sorted(shapes, key=lambda n: n != expect):
        shape, value = shapes[name]
        test = s.rlike(shape)
        parsed = F.when(test, value) if parsed is None else parsed.when(test, value)
    return F.date_trunc("second", parsed)
