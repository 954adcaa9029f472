"""Times of telemetry rows as integers, so that limits compare exactly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(seconds: Column) -> Column:
    """Epoch microseconds of a DOUBLE in seconds, or in milliseconds when above 1e11.

    Null, NaN, infinite and zero values have no time (null).
    """
    usable = F.when(F.isnan(seconds) | (F.abs(seconds) > 1e15) | (seconds == 0), None).otherwise(seconds)
    scaled = F.when(usable > 1e11, usable * 1e3).otherwise(usable * 1e6)
    return F.round(scaled).cast("bigint")


def sample_micros(logged_at: Column, sampled_at: Column) -> Column:
    """Time of a sample: ``logged_at``, or ``sampled_at`` where that is null, NaN or 0."""
    return F.coalesce(epoch_micros(logged_at), epoch_micros(sampled_at))


def iso_micros(text: Column) -> Column:
    """Epoch microseconds of an ISO-8601 date and time in its usual renderings; null where unreadable.

    ``T`` or a blank between date and time, any number of digits of a second, ``Z``, an offset with or
    without a colon, or none (UTC), and padding.
    """
    shape = r"^\s*(\d{4}-?\d{2}-?\d{2})[Tt ]\s*(\d{2}:?\d{2}(?::?\d{2})?)(?:[.,](\d+))?\s*(?:([Zz]|UTC|GMT)|([+-]\d{2}):?(\d{2})?)?\s*$"
    part = lambda k: F.regexp_extract(text, shape, k)
    day = F.regexp_replace(part(1), r"^(\d{4})-?(\d{2})-?(\d{2})$", "$1-$2-$3")
    clock = F.regexp_replace(part(2), ":", "")
    clock = F.concat(F.substring(clock, 1, 2), F.lit(":"), F.substring(clock, 3, 2), F.lit(":"), F.when(F.length(clock) > 4, F.substring(clock, 5, 2)).otherwise(F.lit("00")))
    fraction = F.rpad(F.substring(part(3), 1, 6), 6, "0").cast("bigint")
    zone = F.when(part(5) != "", F.concat(part(5), F.lit(":"), F.when(part(6) != "", part(6)).otherwise(F.lit("00")))).otherwise(F.lit("+00:00"))
    stamp = F.try_to_timestamp(F.concat(day, F.lit("T"), clock, zone))
    return F.when(text.rlike(shape), F.unix_micros(stamp) + F.coalesce(fraction, F.lit(0)))


def spread_over_ranges(micros: Column, width: int, margin: int) -> Column:
    """The numbers of all time ranges of ``width`` microseconds that reach within ``margin`` of a time."""
    first = F.floor((micros - F.lit(margin)) / F.lit(width)).cast("bigint")
    last = F.floor((micros + F.lit(margin)) / F.lit(width)).cast("bigint")
    return F.sequence(first, last)
