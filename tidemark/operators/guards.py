"""Guards against knowledge from after the anchor."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import as_anchor, col
from tidemark.schema import DATE, GUARD_EXEMPT, GUARD_TOKENS, KEY


class LeakageError(ValueError):
    """Feature data reaches past the anchor, in its names or in its rows."""


def suspicious_columns(
    columns: list[str], allowed: list[str] | None = None, tokens: list[str] | None = None
) -> list[str]:
    """Names holding a forbidden token anywhere, in any case."""
    free = {*(allowed or []), *GUARD_EXEMPT}
    words = GUARD_TOKENS if tokens is None else tokens
    return [c for c in columns if c not in free and any(w in c.lower() for w in words)]


def guard_columns(
    df: DataFrame,
    allowed: list[str] | None = None,
    raise_error: bool = True,
    tokens: list[str] | None = None,
) -> list[str]:
    """Refuse (or list) feature columns that look like future knowledge.  Runs no job."""
    found = suspicious_columns(df.columns, allowed, tokens)
    if found and raise_error:
        raise LeakageError(f"columns that look like future knowledge: {', '.join(found)}")
    return found


def guard_report(
    spark: SparkSession, columns: list[str], allowed: list[str] | None = None
) -> DataFrame:
    rows = [(c,) for c in suspicious_columns(columns, allowed)]
    return spark.createDataFrame(rows, "column string")


def boundary_report(
    df: DataFrame, anchor: str | dt.date | Column, date: str = DATE, table: str = "table"
) -> DataFrame:
    """Rows after the anchor and the latest date, in one aggregate."""
    after = col(date) > as_anchor(anchor)
    return df.agg(
        F.lit(table).alias("table"),
        F.count_if(after).alias("rows_after"),
        F.max(col(date)).alias("latest"),
    ).select("table", "rows_after", "latest")


def boundary_metrics(anchor: str | dt.date | Column, date: str = DATE) -> list[Column]:
    """rows, rows_after and latest as aggregates that can be observed while rows pass by."""
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(col(date) > as_anchor(anchor)).alias("rows_after"),
        F.max(col(date)).alias("latest"),
    ]


def assert_boundary(
    df: DataFrame, anchor: str | dt.date, date: str = DATE, table: str = "table"
) -> None:
    """Fail when any row lies after the anchor.  Runs one aggregate job."""
    if date not in df.columns:
        raise KeyError(f"no date column '{date}' in {table}")
    r = boundary_report(df, anchor, date, table).first()
    if r["rows_after"]:
        raise LeakageError(
            f"{table}: {r['rows_after']} rows after {str(anchor)[:10]}, latest {r['latest']}"
        )


def within_boundary(
    df: DataFrame, anchor: str | dt.date | Column, date: str = DATE
) -> tuple[DataFrame, DataFrame]:
    """Split into rows a feature may use and rows to set aside (null dates stay usable)."""
    after = F.coalesce(col(date) > as_anchor(anchor), F.lit(False))
    return df.where(~after), df.where(after)


def shared_keys(left: DataFrame, right: DataFrame, key: str = KEY) -> DataFrame:
    """Keys found on both sides; empty for disjoint sets.

    Both sides are reduced to distinct keys before they meet, so a key held by many
    rows reaches the join once.
    """
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi")


def assert_disjoint(left: DataFrame, right: DataFrame, key: str = KEY) -> None:
    both = [r[0] for r in shared_keys(left, right, key).take(5)]
    if both:
        raise LeakageError(f"'{key}' values on both sides, for example {both}")


def assert_unique(df: DataFrame, key: str = KEY) -> DataFrame:
    """The same rows; the job fails where a key comes twice.

    One grouped count on the key, whose partitioning the following join reuses.  A
    group that passes has one row, so each column's minimum is simply its value.
    """
    rest = [c for c in df.columns if c != key]
    once = df.groupBy(key).agg(
        F.count("*").alias("_n"), *[F.min(col(c)).alias(c) for c in rest]
    )
    fail = F.raise_error(F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string")))
    checked = F.when(F.col("_n") > 1, fail.cast(df.schema[key].dataType)).otherwise(F.col(key))
    return once.select(checked.alias(key), *[col(c) for c in rest])
