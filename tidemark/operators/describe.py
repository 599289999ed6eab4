"""Descriptive tables: frequencies, rates, summaries, correlation and fits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import cell, null_if_nan, numeric_columns
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import durable, join_checked, settle

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
PAIRS_AT_ONCE = 300  # pairs of one built-in aggregate; more are blocks of co-moments


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Count and share of every non-null value, most frequent first."""
    counts = durable(
        df.where(cell(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"))
    )
    total = counts.agg(F.sum("count")).first()[0] or 0
    share = F.try_divide(F.col("count"), F.lit(total).cast("double"))
    return counts.withColumn("share", share).orderBy(F.desc("count"), F.asc(column))


def event_rate(df: DataFrame, by: list[str], flag: Column, descending: bool = True) -> DataFrame:
    """Rows and event percentage per dimension value, ordered by rate."""
    out = df.groupBy(*by).agg(
        F.count("*").alias("count"), (F.avg(flag.cast("double")) * 100).alias("rate_pct")
    )
    first = F.desc("rate_pct") if descending else F.asc("rate_pct")
    return out.orderBy(first, *by)


def number(column: str) -> Column:
    """A column as double with NaN as null: what every summary below looks at."""
    return null_if_nan(cell(column).cast("double"))


def long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(keep..., feature, value) rows; values as doubles."""
    keep = list(keep or [])
    cast = df.select(*keep, *[cell(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(keep, columns, "feature", "value")


def _moments(x: Column) -> list[Column]:
    return [
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    ]


def describe(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per column (and group)."""
    by = list(by or [])
    rows = long_form(df, columns, by)
    x = number("value")
    return exact_quantiles(rows, "value", QUARTILES, [*by, "feature"], extra=_moments(x))


def group_summary(
    df: DataFrame, by: list[str], value: str, descending: bool = True
) -> DataFrame:
    """count, mean, median, std, min and max per dimension, ordered by median."""
    x = number(value)
    out = exact_quantiles(df, value, {"median": 0.5}, by, extra=_moments(x))
    first = F.desc("median") if descending else F.asc("median")
    return out.orderBy(first, *by)


def spread(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Quartiles and their distance."""
    q = exact_quantiles(df, value, {"q1": 0.25, "q3": 0.75}, by)
    return q.withColumn("iqr", F.col("q3") - F.col("q1"))


def tail_by_class(df: DataFrame, value: str, by: list[str], prob: float = 0.75) -> DataFrame:
    """An upper quantile and the maximum per class."""
    return exact_quantiles(
        df, value, {"quantile": prob}, by, extra=[F.max(number(value)).alias("max")]
    )


def profile_feature(df: DataFrame, column: str) -> DataFrame:
    """(metric, value) card of one column; numeric metrics are N/A for text columns."""
    kind = df.schema[column].dataType
    x = cell(column)
    if not isinstance(kind, T.NumericType):
        gone = x.isNull()
        one = df.agg(F.count(x).alias("n"), F.avg(gone.cast("double")).alias("gone"))
        stats = ["N/A"] * 5
        pairs = dict(zip(["Mean", "Std Dev", "Min", "Median", "Max"], map(F.lit, stats)))
    else:
        xd = x.cast("double")
        gone = xd.isNull() | F.isnan(xd)
        v = F.when(~gone, xd)
        one = exact_quantiles(
            df.select(xd.alias(column)),
            column,
            {"median": 0.5},
            extra=[F.avg(gone.cast("double")).alias("gone"), F.count(v).alias("n"),
                   F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                   F.min(v).alias("min"), F.max(v).alias("max")],
        )
        pairs = {
            "Mean": F.format_string("%.3f", "mean"),
            "Std Dev": F.format_string("%.3f", "std"),
            "Min": F.format_string("%.3f", "min"),
            "Median": F.format_string("%.3f", "median"),
            "Max": F.format_string("%.3f", "max"),
        }
    card = {
        "Data Type": F.lit(kind.simpleString()),
        "Count": F.col("n").cast("string"),
        "Missing %": F.concat(F.format_string("%.2f", F.col("gone") * 100), F.lit("%")),
        **pairs,
    }
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in card.items()])
    return one.select(F.inline(rows))


def class_means(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Mean of each column per class and rows per class."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), *[F.avg(number(c)).alias(f"mean_{c}") for c in columns]
    )


def center(df: DataFrame, value: str) -> DataFrame:
    """Overall mean and median: the reference lines of a histogram."""
    return exact_quantiles(df, value, {"median": 0.5}, extra=[F.avg(number(value)).alias("mean")])


def dataset_kpis(df: DataFrame, label: str) -> DataFrame:
    y = cell(label)
    return df.agg(
        F.count("*").alias("entities"),
        F.lit(len(df.columns)).alias("columns"),
        F.count_if(y == 1).alias("positives"),
        (F.avg((y == 1).cast("double")) * 100).alias("positive_rate_pct"),
    )


def _upper(vals: DataFrame, names: list[str]) -> DataFrame:
    """(x, y, corr) of every pair of few columns, x not after y, by one built-in aggregate."""
    pairs = [*combinations(names, 2), *[(n, n) for n in names]]

    def corr(a: str, b: str) -> Column:
        return F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.corr(cell(a), cell(b)).alias("corr"))

    return vals.agg(F.array(*[corr(a, b) for a, b in pairs]).alias("p")).select(F.inline("p"))


def comoments(vals: DataFrame, names: list[str]) -> DataFrame:
    """(x, y, n, mx, my, cxx, cyy, cxy) per pair of columns and partition, from one scan.

    Means and sums of products are those of the rows where both columns have a value.  A
    partition is a few matrix products over batches of rows; batches are merged by their
    means, so large values do not cancel.  Pairs without rows in a partition are left out.
    """
    size = len(names)
    first, second = np.triu_indices(size)

    def merged(a: list[np.ndarray] | None, b: list[np.ndarray]) -> list[np.ndarray]:
        if a is None:
            return b
        n = a[0] + b[0]
        safe = np.maximum(n, 1)
        dx, dy, w = b[1] - a[1], b[2] - a[2], a[0] * b[0] / safe
        return [
            n, a[1] + dx * b[0] / safe, a[2] + dy * b[0] / safe,
            a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w,
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            known = ~np.isnan(block)
            there = known.astype(float)
            shift = np.where(known, block, 0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
            x = np.where(known, block - shift, 0.0)
            n = there.T @ there
            safe = np.maximum(n, 1)
            sx, sxx, sxy = x.T @ there, (x * x).T @ there, x.T @ x
            mx, my = sx / safe, sx.T / safe
            part = [
                n, mx + shift[:, None], my + shift[None, :],
                sxx - n * mx * mx, sxx.T - n * my * my, sxy - n * mx * my,
            ]
            total = merged(total, part)
        if total is None:
            return
        keep = total[0][first, second] > 0
        i, j = first[keep], second[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(m[i, j], pa.float64()) for m in total]],
            names=["x", "y", "n", "mx", "my", "cxx", "cyy", "cxy"],
        )

    schema = "x int, y int, n double, mx double, my double, cxx double, cyy double, cxy double"
    return vals.mapInArrow(run, schema)


def _upper_wide(vals: DataFrame, names: list[str]) -> DataFrame:
    """(x, y, corr) of every pair from partition co-moments: as many rows as partitions times pairs."""
    parts = durable(comoments(vals, names))
    means = parts.groupBy("x", "y").agg(
        (F.sum(F.col("n") * F.col("mx")) / F.sum("n")).alias("ox"), (F.sum(F.col("n") * F.col("my")) / F.sum("n")).alias("oy")
    )
    dx, dy, n = F.col("mx") - F.col("ox"), F.col("my") - F.col("oy"), F.col("n")
    sums = parts.join(means, ["x", "y"]).groupBy("x", "y").agg(
        F.sum(F.col("cxx") + n * dx * dx).alias("xx"),
        F.sum(F.col("cyy") + n * dy * dy).alias("yy"),
        F.sum(F.col("cxy") + n * dx * dy).alias("xy"),
    )
    corr = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    size = len(names)
    every = vals.sparkSession.range(size).select(F.col("id").cast("int").alias("x")).select(
        "x", F.explode(F.sequence(F.col("x"), F.lit(size - 1))).alias("y")
    )
    named = F.array(*[F.lit(c) for c in names])
    return every.join(sums.select("x", "y", corr.alias("corr")), ["x", "y"], "left").select(
        named[F.col("x")].alias("x"), named[F.col("y")].alias("y"), "corr"
    )


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation as (x, y, corr), both triangles and diagonal.

    Every pair is in the result, with a null where no row has both values or one of them has
    no spread.  The rows are read once: few pairs are one aggregate, many are blocks of
    co-moments per partition.
    """
    names = columns or numeric_columns(df)
    vals = df.select(*[number(c).alias(c) for c in names])
    upper = _upper(vals, names) if len(names) * (len(names) + 1) // 2 <= PAIRS_AT_ONCE else _upper_wide(vals, names)
    both = F.array(F.struct("x", "y", "corr"),
                   F.struct(F.col("y").alias("x"), F.col("x").alias("y"), "corr"))
    same = F.array(F.struct("x", "y", "corr"))
    return upper.select(F.inline(F.when(F.col("x") == F.col("y"), same).otherwise(both)))


def linear_fit(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares line of y on x with correlation and r²."""
    a, b = number(x), number(y)
    return df.groupBy(*(by or [])).agg(
        F.regr_count(b, a).alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.regr_r2(b, a).alias("r2"),
        F.corr(a, b).alias("corr"),
    )


def box_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers (furthest points within 1.5 IQR) and outlier counts per class."""
    df = df.select(*by, number(value).alias(value))
    x = cell(value)
    quarters = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    q = settle(exact_quantiles(df, value, quarters, by, extra=[F.count("*").alias("_rows")]))
    rows = join_checked(df.select(*by, x), q, by, sizes="_rows")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ok = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(ok, x)).alias("whisker_low"),
        F.max(F.when(ok, x)).alias("whisker_high"),
        F.count_if(~ok).alias("outliers"),
    )


def band_shares(
    df: DataFrame, value: str, edges: list[float], flag: Column | None = None
) -> DataFrame:
    """Entities, share and event rate per band cut at ``edges`` (each edge opens its band)."""
    cuts = sorted(edges)
    x = number(value)
    band = sum([(x >= F.lit(float(e))).cast("int") for e in cuts], F.lit(0))
    lows = F.array(*[F.lit(None).cast("double"), *[F.lit(float(e)) for e in cuts]])
    highs = F.array(*[*[F.lit(float(e)) for e in cuts], F.lit(None).cast("double")])
    event = flag if flag is not None else F.lit(None).cast("boolean")
    counts = durable(
        df.where(x.isNotNull())
        .groupBy(band.alias("band"))
        .agg(F.count("*").alias("count"), (F.avg(event.cast("double")) * 100).alias("rate_pct"))
    )
    total = counts.agg(F.sum("count")).first()[0] or 0
    return counts.select(
        "band",
        lows[F.col("band")].alias("low"),
        highs[F.col("band")].alias("high"),
        "count",
        F.try_divide(F.col("count"), F.lit(total).cast("double")).alias("share"),
        "rate_pct",
    )


def share_beyond(df: DataFrame, lines: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Share of entities beyond each reference line: {name: (column, '>' or '<', edge)}."""
    items = []
    for name, (c, side, edge) in lines.items():
        past = (number(c) > edge) if side == ">" else (number(c) < edge)
        items.append(
            F.struct(
                F.lit(name).alias("line"),
                F.lit(float(edge)).alias("edge"),
                F.count_if(past).alias("beyond"),
                F.avg(past.cast("double")).alias("share"),
            )
        )
    return df.agg(F.array(*items).alias("a")).select(F.inline("a"))
