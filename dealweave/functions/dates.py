"""Date parsing and formatting as Columns. Formats are tried in order; the first that fits wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealweave.functions.text import squash, strip

# fixed values: accepted shapes, in order of preference
MAIL_FORMATS = (
    "M/d/yyyy h:mm a", "M/d/yyyy H:mm", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s",
    "d/M/yyyy H:mm", "M/d/yy h:mm a",
)
CALENDAR_FORMATS = (
    "M/d/yyyy h:mm a", "M/d/yyyy H:mm", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s",
    "yyyy-M-d'T'H:m:s.SSSSSS", "yyyy-M-d'T'H:m:s'Z'", "d/M/yyyy H:mm", "M/d/yy h:mm a",
    "yyyyMMdd'T'HHmmss'Z'", "yyyyMMdd'T'HHmmss",
)
ISO_OUT = "yyyy-MM-dd'T'HH:mm:ss"


def _first_fit(c: Column, formats) -> Column:
    text = strip(F.coalesce(c, F.lit("")))

    def fit(fmt: str) -> Column:
        ts = F.try_to_timestamp(text, F.lit(fmt))
        if "/yy " not in fmt:
            return ts
        # two-digit years from 69 on belong to the 1900s
        return F.when(F.year(ts) >= 2069, F.add_months(ts, -1200).cast("timestamp")
                      + (ts - F.date_trunc("day", ts))).otherwise(ts)

    return F.coalesce(*map(fit, formats))


def calendar_time(c: Column) -> Column:
    return _first_fit(c, CALENDAR_FORMATS)


def mail_date(c: Column) -> Column:
    """ISO string when a format fits, the raw text otherwise, null when blank."""
    return F.when(
        F.coalesce(c, F.lit("")) != "",
        F.coalesce(F.date_format(_first_fit(c, MAIL_FORMATS), ISO_OUT), c),
    )


def any_time(c: Column) -> Column:
    """ISO text (with or without zone), then the mail formats, then a plain date."""
    text = squash(c)
    return F.coalesce(
        F.try_to_timestamp(text), _first_fit(text, MAIL_FORMATS + ("M/d/yyyy",))
    )


def short_date(c: Column) -> Column:
    return F.coalesce(F.date_format(any_time(c), "MM/dd/yyyy"), F.substring(squash(c), 1, 10))


def epoch_of(*candidates: Column) -> Column:
    """Epoch seconds of the first candidate that parses, else 0."""
    parsed = [F.unix_timestamp(F.try_to_timestamp(strip(F.coalesce(c, F.lit(""))))) for c in candidates]
    return F.coalesce(*parsed, F.lit(0)).cast("long")


def minutes_between(start: Column, end: Column) -> Column:
    return ((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60).cast("int")


def in_period(ts: Column, day: str, period: str = "day") -> Column:
    """Same day, or same Monday-based week, as ``day``."""
    target = F.lit(day).cast("date")
    if period == "week":
        return F.date_trunc("week", ts) == F.date_trunc("week", target.cast("timestamp"))
    return F.to_date(ts) == target


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "hh:00 a")
