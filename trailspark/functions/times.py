"""Readable times: ISO 8601 texts and epoch milliseconds, as microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the accepted ISO 8601 form (date, time, optional fraction, optional offset).
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|z|[+-]\d{2}(:?\d{2})?)?$"
# Fixed value: epoch milliseconds, 9 to 15 digits.
EPOCH_MS = r"^-?\d{9,15}$"


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a time text; NULL when unreadable.

    Null, empty and any text that is neither ISO 8601 nor epoch milliseconds
    give NULL; a text without offset counts as UTC.
    """
    t = F.trim(c)
    iso = F.regexp_replace(F.upper(t), ",", ".")
    iso = F.regexp_replace(iso, r"^(.{10})[T ](\d{2}:\d{2})(?=$|[Z+-])", "$1T$2:00")
    # An offset of the form +hh or +hhmm is spelt +hh:mm for the cast.
    iso = F.regexp_replace(iso, r"(:\d{2}(?:\.\d+)?|T\d{2}:\d{2})([+-]\d{2})$", "$1$2:00")
    iso = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(iso.rlike(r"([Z]|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.when(t.rlike(EPOCH_MS), t.try_cast("bigint") * 1000).when(
        t.rlike(ISO), F.unix_micros(iso.try_cast("timestamp"))
    )


def millis(c: Column) -> Column:
    """Like :func:`micros`, in whole milliseconds."""
    return F.floor(micros(c) / 1000).cast("bigint")


def week_key(us: Column) -> Column:
    """Monday (UTC) of a time in microseconds, ``yyyy-MM-dd``."""
    day = F.floor(us / F.lit(86_400_000_000)).cast("int")
    # Day 0 of the epoch was a Thursday; 3 days after a Monday.
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day - F.pmod(day + 3, F.lit(7))), "yyyy-MM-dd")
