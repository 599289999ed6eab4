"""Trailing-window aggregates around an anchor date.

All windows of one table are computed by one grouped aggregation: rows are cut to
the widest window once, narrower windows are conditions inside the aggregates.
Every aggregate combines before the shuffle, so a heavy entity costs no more there
than any other.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import as_anchor, cell, col
from tidemark.schema import ANCHOR, DATE, KEY
from tidemark.session import Settled, join_checked, settle


class Span(NamedTuple):
    """Days ``[anchor - first, anchor - last]``, both ends included."""

    name: str
    first: int
    last: int = 0


DAYS_7 = Span("7d", 6)
DAYS_14 = Span("14d", 13)
DAYS_30 = Span("30d", 29)
WEEK_BEFORE = Span("prev_7d", 13, 7)


def trailing(days: int) -> Span:
    return Span(f"{days}d", days - 1)


def inside(day: Column, anchor: Column, span: Span) -> Column:
    return day.between(F.date_sub(anchor, span.first), F.date_sub(anchor, span.last))


def window_slice(
    df: DataFrame, anchor: str | dt.date | Column, days: int, date: str = DATE
) -> DataFrame:
    """Rows of the last ``days`` days, anchor day included."""
    if date not in df.columns:
        raise KeyError(f"cannot cut a window without the date column '{date}'")
    return df.where(inside(col(date), as_anchor(anchor), trailing(days)))


def previous_week(
    df: DataFrame, anchor: str | dt.date | Column, date: str = DATE
) -> DataFrame:
    """Rows of the week before the last seven days."""
    return df.where(inside(col(date), as_anchor(anchor), WEEK_BEFORE))


def anchor_windows(
    anchors: DataFrame, days: int, key: str = KEY, anchor: str = ANCHOR
) -> tuple[Settled, dt.date | None, dt.date | None]:
    """Every anchor once per bucket of ``days`` days its window touches, and the first and last day of all windows.

    A window of as many days as a bucket touches two buckets at most.
    """
    first = F.date_sub(col(anchor), days - 1)
    bucket = lambda d: F.floor(F.unix_date(d) / days).cast("int")
    known = anchors.select(key, col(anchor).cast("date").alias(anchor)).dropna().distinct()
    met = settle(
        known.select(key, anchor, F.explode(F.array_distinct(F.array(bucket(first), bucket(col(anchor))))).alias("_bucket"))
    )
    low, high = met.df.agg(F.min(first), F.max(anchor)).first()
    return met, low, high


def at_anchors(
    df: DataFrame,
    windows: tuple[Settled, dt.date | None, dt.date | None],
    days: int,
    key: str = KEY,
    date: str = DATE,
    anchor: str = ANCHOR,
) -> DataFrame:
    """Rows inside the last ``days`` days of each anchor of their entity, with that anchor.

    An interval join: rows and ``anchor_windows`` meet on entity and bucket of days, so an
    entity's rows far from its anchors meet nothing and its near ones are spread over its
    buckets.  The range of all windows is a filter of constants, which reaches the scan.
    """
    if date not in df.columns:
        raise KeyError(f"cannot cut a window without the date column '{date}'")
    met, low, high = windows
    rows = df.drop(anchor).where(col(date).between(F.lit(low).cast("date"), F.lit(high).cast("date")))
    rows = rows.withColumn("_bucket", F.floor(F.unix_date(col(date)) / days).cast("int"))
    joined = join_checked(rows, met, [key, "_bucket"]).drop("_bucket")
    return joined.where(inside(col(date), col(anchor), trailing(days)))


class Measure(NamedTuple):
    """One output column: ``how`` over ``value`` within ``span``.

    ``how`` is mean, std, min, max, sum, count, latest or hits (rows where the
    boolean ``value`` holds).  ``order`` ranks rows for latest, newest last.
    """

    name: str
    span: Span
    how: str
    value: Column
    order: Column | None = None


def _aggregate(m: Measure, here: Column | None) -> Column:
    def only(x: Column) -> Column:
        return x if here is None else F.when(here, x)

    if m.how == "mean":
        return F.avg(only(m.value))
    if m.how == "std":
        # One row has no spread: zero.  No row at all stays unknown.
        rows = F.count(only(F.lit(1)))
        return F.when(rows > 0, F.coalesce(F.stddev_samp(only(m.value)), F.lit(0.0)))
    if m.how == "min":
        return F.min(only(m.value))
    if m.how == "max":
        return F.max(only(m.value))
    if m.how == "sum":
        return F.coalesce(F.sum(only(m.value)), F.lit(0.0))
    if m.how == "count":
        return F.count(only(m.value))
    if m.how == "hits":
        return F.count_if(m.value if here is None else (here & m.value))
    if m.how == "latest":
        known = m.value.isNotNull() if here is None else (here & m.value.isNotNull())
        return F.max_by(m.value, F.when(known, m.order))
    raise ValueError(f"unknown aggregate '{m.how}'")


def window_agg(
    df: DataFrame,
    anchor: str | dt.date | Column,
    measures: list[Measure],
    key: str = KEY,
    date: str = DATE,
) -> DataFrame:
    """One row per entity with rows in the widest window of ``measures``."""
    day, at = col(date), as_anchor(anchor)
    spans = {m.span for m in measures}
    widest = Span("all", max(s.first for s in spans), min(s.last for s in spans))
    cut = df.where(inside(day, at, widest))

    def here(span: Span) -> Column | None:
        same = (span.first, span.last) == (widest.first, widest.last)
        return None if same else inside(day, at, span)

    return cut.groupBy(key).agg(*[_aggregate(m, here(m.span)).alias(m.name) for m in measures])


def daily_moments(df: DataFrame, value: str, key: str = KEY, date: str = DATE) -> DataFrame:
    """Mergeable day summaries: one row per entity and day, however many readings."""
    x = col(value)
    return df.groupBy(key, date).agg(
        F.count(x).alias("n"),
        F.sum(x).alias("total"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        (F.var_pop(x) * F.count(x)).alias("m2"),
    )


def rolling_daily(
    df: DataFrame, value: str, days: int = 7, key: str = KEY, date: str = DATE
) -> DataFrame:
    """Trailing mean, sum and count for every entity and day that has readings.

    Works on day summaries, so an entity's window holds at most one row per day.
    """
    ordinal = F.datediff(col(date), F.lit(dt.date(1970, 1, 1)))
    back = W.partitionBy(key).orderBy("_day").rangeBetween(-(days - 1), 0)
    return (
        daily_moments(df, value, key, date)
        .withColumn("_day", ordinal)
        .select(
            key,
            date,
            F.sum("n").over(back).alias(f"n_{days}d"),
            F.sum("total").over(back).alias(f"sum_{days}d"),
            F.try_divide(F.sum("total").over(back), F.sum("n").over(back)).alias(f"avg_{days}d"),
        )
    )


def moments_at_anchors(
    df: DataFrame,
    anchors: DataFrame,
    value: str,
    spans: list[Span],
    key: str = KEY,
    date: str = DATE,
    anchor: str = "obs_window_end",
) -> DataFrame:
    """Mean, sample spread, minimum and maximum per span, each entity at its own anchor.

    Readings are folded to day summaries before they meet the anchors, so the join
    sees at most one row per entity and day.  ``anchors`` has one row per entity.
    """
    days = daily_moments(df, value, key, date)
    met = anchors.select(key, anchor).join(days, key, "left")
    # Spread is taken around the span's own mean, which keeps it exact for large values.
    whole = W.partitionBy(key, anchor)
    means, aggs = {}, []
    for i, s in enumerate(spans):
        here = inside(col(date), col(anchor), s) & (F.col("n") > 0)
        total, n = F.sum(F.when(here, F.col("total"))), F.sum(F.when(here, F.col("n")))
        mean = f"_m{i}"
        means[mean] = F.try_divide(total.over(whole), n.over(whole))
        off = F.col("total") / F.col("n") - F.col(mean)
        m2 = F.sum(F.when(here, F.col("m2") + F.col("n") * off * off))
        aggs += [
            F.try_divide(total, n).alias(f"avg_{s.name}"),
            F.when(n > 1, F.sqrt(F.try_divide(m2, n - 1)))
            .when(F.count(F.when(inside(col(date), col(anchor), s), 1)) > 0, 0.0)
            .alias(f"std_{s.name}"),
            F.min(F.when(here, F.col("low"))).alias(f"min_{s.name}"),
            F.max(F.when(here, F.col("high"))).alias(f"max_{s.name}"),
        ]
    return met.withColumns(means).groupBy(key, anchor).agg(*aggs)


LG_K = 14  # sketch of 2^14 registers: relative error 0.8 %
SKETCH_ERROR = 1.04 / 2 ** (LG_K / 2)


def distinct_by_window(
    df: DataFrame, days: tuple[int, ...] = (7, 14, 30), key: str = KEY, date: str = DATE
) -> DataFrame:
    """Entities seen in the last ``days`` days of every day of the data, exact and from sketches.

    day, days, exact, estimate.  Exact: an entity seen on a day is in the windows that end on
    it and the following ones, until it is seen again or the window has passed; so each
    (entity, day) row adds one and takes one away, and the counts are running sums over days.
    Estimate: one sketch a day, merged over the window, for tables whose (entity, day) rows
    are too many or gone.  Rows without entity or day are left out.
    """
    one = F.lit(1).cast("long")
    seen = df.select(cell(key).alias("_k"), col(date).alias("day")).dropna().distinct()
    ends = seen.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    again = F.lead("day").over(W.partitionBy("_k").orderBy("day"))
    widths = F.array(*[F.lit(d) for d in days])
    stays = seen.withColumn("again", again).select("day", "again", F.explode(widths).alias("days"))
    leaves = F.least(F.coalesce("again", F.date_add("day", F.col("days"))), F.date_add("day", F.col("days")))
    steps = F.array(F.struct(F.col("day").alias("at"), one.alias("n")), F.struct(leaves.alias("at"), (-one).alias("n")))
    moves = stays.select("days", F.inline(steps)).groupBy("days", "at").agg(F.sum("n").alias("n"))
    # From here on a row is a day: their number is that of the calendar, not of the data.
    calendar = ends.select(F.explode(F.sequence("first", "last")).alias("day")).select("day", F.explode(widths).alias("days"))
    upto = W.partitionBy("days").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    exact = (
        calendar.join(moves.withColumnRenamed("at", "day"), ["days", "day"], "left")
        .select("days", "day", F.coalesce(F.sum("n").over(upto), F.lit(0)).cast("long").alias("exact"))
    )
    sketches = seen.groupBy("day").agg(F.hll_sketch_agg("_k", LG_K).alias("sketch"))
    reached = sketches.select("sketch", "day", F.explode(widths).alias("days")).select(
        "sketch", "days", F.explode(F.sequence("day", F.date_add("day", F.col("days") - 1))).alias("day")
    )
    merged = reached.groupBy("days", "day").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    return exact.join(merged, ["days", "day"], "left").select(
        "day", "days", "exact", F.coalesce("estimate", F.lit(0).cast("long")).alias("estimate")
    )
