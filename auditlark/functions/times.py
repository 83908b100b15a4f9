"""Time helpers; every time is UTC and stored as microseconds since the epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

US = 1_000_000


def coerce_us(value: Column) -> Column:
    """Epoch seconds (number or numeric text) or ISO-8601 text to microseconds; else null.

    Times without a zone are UTC.
    """
    text = strip(value.cast("string"))
    number = text.try_cast("double")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return F.coalesce(F.round(number * US).cast("long"), F.unix_micros(iso))


def iso_utc(ts_us: Column) -> Column:
    return F.date_format(F.timestamp_micros(ts_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def stamp_utc(ts_us: Column) -> Column:
    """The text form kept in ledgers and case files."""
    return F.date_format(F.timestamp_micros(ts_us), "yyyy-MM-dd HH:mm:ss 'UTC'")


def parse_stamp(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss 'UTC'")))
