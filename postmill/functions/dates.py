"""Ages and step functions. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy")


def parsed(text: Column) -> Column:
    """A timestamp from any of the known formats, then ISO-8601 (only texts that begin with a full date); else null."""
    t = F.trim(text)
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]
    iso = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}")), t).try_cast("timestamp")
    return F.coalesce(*tries, iso)


def days_between(then: Column, as_of: Column) -> Column:
    """Whole elapsed days, rounded down also for the future."""
    return F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))) / 86400)


def days_since(text: Column, as_of: Column) -> Column:
    return days_between(parsed(text), as_of)


def stepped(value: Column, steps: list[tuple[float, int]]) -> Column:
    """Points of the first limit that the value doesn't exceed; null above all limits or without a value."""
    out = None
    for limit, points in steps:
        out = F.when(value <= limit, points) if out is None else out.when(value <= limit, points)
    return out


def expired(valid_through: Column, as_of: Column) -> Column:
    """Whether a closing date has passed; a date that can't be read hasn't."""
    return F.coalesce(parsed(valid_through) < as_of.cast("timestamp"), F.lit(False))


def retry_delay(attempt: Column, status: Column, retry_after: Column) -> Column:
    """Seconds before the next try: 1.6 to the attempt's power, at most 30; a 429 waits as told, up to 120, or 2 more."""
    told = retry_after.try_cast("double")
    base = F.least(F.lit(30.0), F.pow(F.lit(1.6), attempt))
    return F.when(status == 429, F.when(told.isNotNull(), F.least(told, F.lit(120.0))).otherwise(base + 2)).otherwise(base)


def age_in_note(note: Column) -> Column:
    """The number of days that an explanation such as ``12d old`` states."""
    return F.regexp_extract(note, r"(\d+)d\b", 1).try_cast("int")
