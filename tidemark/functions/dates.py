"""Date handling: one conversion at the source, dates everywhere after it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["as_anchor", "day_of", "parse_moment"]

# Accepted text layouts, ISO first.
_LAYOUTS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "M/d/yyyy h:mm:ss a",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "yyyy/M/d",
]


def parse_moment(text: Column) -> Column:
    """Tolerant timestamp parse; what cannot be read becomes null."""
    tries = [F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in _LAYOUTS]
    return F.coalesce(*tries, text.try_cast("timestamp_ntz"))


def day_of(text: Column) -> Column:
    """Calendar day of a text date or timestamp."""
    return F.coalesce(text.try_cast("date"), parse_moment(text).cast("date"))


def as_anchor(anchor: str | dt.date | Column) -> Column:
    """Anchor as a date expression; text keeps its first ten characters."""
    if isinstance(anchor, Column):
        return anchor
    if isinstance(anchor, dt.datetime):
        anchor = anchor.date()
    if isinstance(anchor, dt.date):
        return F.lit(anchor)
    return F.lit(dt.date.fromisoformat(str(anchor)[:10]))
