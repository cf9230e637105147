"""Column expressions for times. Naive texts are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORMATS = ("d/M/yyyy H:mm[:ss]", "d/M/yyyy h:mm[:ss] a")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_iso(c: str | Column) -> Column:
    """ISO text to timestamp; without an offset it is UTC, unreadable text is null."""
    return _col(c).cast("string").try_cast("timestamp")


def parse_any(c: str | Column, day_first: bool = True) -> Column:
    """ISO first, then dates with slashes and one or two digits, day before month as the labelled corpora have them, or month before day.

    A date that fits only the other order (13 is no month) is read in that order.
    """
    text = F.trim(_col(c).cast("string"))
    other = [f.replace("d/M", "M/d") for f in _FORMATS]
    formats = [*_FORMATS, *other] if day_first else [*other, *_FORMATS]
    return F.coalesce(parse_iso(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def alert_millis(timestamp: Column, seconds: Column, year: int | None = None) -> Column:
    """Milliseconds of an alert: its epoch seconds, else its text, ISO or ``[yy/]MM/dd-HH:mm:ss[.ffffff]``. A text without a year takes ``year``, or is null without one."""
    text = F.trim(timestamp)
    short = F.when(text.rlike(r"^\d{2}/\d{2}-"), F.concat(F.lit(f"{year % 100:02d}/"), text)) if year is not None else F.lit(None).cast("string")
    dated = F.coalesce(F.when(text.rlike(r"^\d{2}/\d{2}/\d{2}-"), text), short)
    parsed = F.coalesce(parse_iso(text), F.try_to_timestamp(dated, F.lit("yy/MM/dd-HH:mm:ss[.SSSSSS]")))
    return F.coalesce((safe_double(seconds) * 1000).cast("long"), F.unix_millis(parsed))


def safe_double(c: str | Column) -> Column:
    return _col(c).try_cast("double")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds with microseconds, as double."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def hour_of(c: str | Column) -> Column:
    return F.date_trunc("hour", _col(c))
