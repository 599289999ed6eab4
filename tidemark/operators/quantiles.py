"""Exact, linearly interpolated quantiles by bracketing.

The built-in exact percentile keeps every distinct value of a group in one
aggregation buffer.  Here a bounded sketch first brackets each wanted rank; the
second pass keeps single values only inside the brackets and collapses everything
else to one count per gap, before the shuffle.  The rank is then read off the
running counts, so the result is exact whatever the distribution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import cell
from tidemark.operators.ordering import running_totals
from tidemark.session import join_checked, settle

ACCURACY = 10_000
SMALL_GROUP = 20 * ACCURACY  # such groups are bracketed by their own minimum and maximum
ONE_TASK_VALUES = 5_000_000


def _plus(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _rejoin(stats: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Groups back to their first-pass numbers; without groups, one row to one row."""
    if by:
        return stats.join(found, by, "left")
    one = F.lit(1)
    return stats.withColumn("_one", one).join(found.withColumn("_one", one), "_one", "left")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: list[str] | None = None,
    extra: list[Column] | None = None,
    accuracy: int = ACCURACY,
    small_group: int = SMALL_GROUP,
    one_task_values: int = ONE_TASK_VALUES,
) -> DataFrame:
    """One row per ``by`` group with a column per entry of ``probs``.

    ``extra`` aggregates ride along in the first pass.  Rows with a null group are
    left out, as are null and NaN values.
    """
    by = list(by or [])
    slim = df
    for b in by:
        slim = slim.where(cell(b).isNotNull())
    x = cell(value).cast("double")
    slim = slim.withColumn("_x", F.when(~F.isnan(x), x))

    slack = 3.0 / accuracy
    lows = [max(p - slack, 0.0) for p in probs.values()]
    highs = [min(p + slack, 1.0) for p in probs.values()]
    sketch = F.percentile_approx("_x", lows + highs, accuracy)
    extra = list(extra or [])
    stats = slim.groupBy(*by).agg(
        F.count("_x").alias("_n"),
        F.min("_x").alias("_min"),
        F.max("_x").alias("_max"),
        sketch.alias("_q"),
        *extra,
    )
    k = len(probs)
    small = F.col("_n") <= F.lit(small_group)
    edges = {}
    for i, (lo, hi) in enumerate(zip(lows, highs)):
        edges[f"_lo{i}"] = F.when(small | F.lit(lo <= 0.0), F.col("_min")).otherwise(F.col("_q")[i])
        edges[f"_hi{i}"] = F.when(small | F.lit(hi >= 1.0), F.col("_max")).otherwise(
            F.col("_q")[k + i]
        )
    settled = settle(stats.withColumns(edges).drop("_q", "_min", "_max"))
    stats = settled.df
    if settled.rows is not None:
        largest = max((r["_n"] for r in settled.rows), default=0)
    else:
        largest = stats.agg(F.max("_n")).first()[0] or 0
    own = {"_n", *edges}
    kept = [c for c in stats.columns if c not in own or c in by]
    vals = slim.where(F.col("_x").isNotNull()).select(*by, "_x")

    if largest <= small_group:
        # Every group's buffer is now known to be bounded: one built-in aggregate will do.
        quick = vals.groupBy(*by).agg(
            *[F.percentile("_x", p).alias(n) for n, p in probs.items()]
        )
        return _rejoin(stats, quick, by).select(*kept, *probs)

    if by:
        vals = join_checked(vals, settled.select(*by, *edges, "_n"), by, sizes="_n")
    else:
        row = settled.rows[0]
        vals = vals.withColumns({e: F.lit(row[e]).cast("double") for e in edges})
    opened = _plus([(F.col("_x") >= F.col(f"_lo{i}")).cast("int") for i in range(k)])
    closed = _plus([(F.col("_x") > F.col(f"_hi{i}")).cast("int") for i in range(k)])
    counts = (
        vals.select(
            *by,
            (opened + closed).alias("_seg"),
            F.when(opened > closed, F.col("_x")).alias("_v"),
        )
        .groupBy(*by, "_seg", "_v")
        .agg(F.count("*").alias("_c"))
    )

    if max(small_group, largest * 2 * slack * k) <= one_task_values:
        upto = W.partitionBy(*by).orderBy("_seg", "_v").rowsBetween(W.unboundedPreceding, 0)
        ranked = counts.withColumn("_cum", F.sum("_c").over(upto))
    else:
        ranked = running_totals(
            counts, [F.col("_seg").asc(), F.col("_v").asc()], {"_cum": F.col("_c")}, by
        )
    n = F.col("_n")
    picks = []
    if by:
        ranked = join_checked(ranked, settled.select(*by, "_n"), by, even=True)
    else:
        ranked = ranked.withColumn("_n", F.lit(largest).cast("long"))
    for i, p in enumerate(probs.values()):
        at = (n - 1) * F.lit(float(p))
        for side, idx in (("l", F.floor(at)), ("h", F.ceil(at))):
            # First value whose running count passes the zero-based rank.
            reach = F.when(F.col("_cum") > idx, F.col("_cum"))
            picks.append(F.min_by("_v", reach).alias(f"_{side}{i}"))
            picks.append(F.count(reach).alias(f"_k{side}{i}"))
    found = ranked.groupBy(*by).agg(*picks)
    out = {}
    for i, (name, p) in enumerate(probs.items()):
        at = (n - 1) * F.lit(float(p))
        share = at - F.floor(at)
        lo, hi = F.col(f"_l{i}"), F.col(f"_h{i}")
        missed = (n > 0) & (lo.isNull() | hi.isNull())
        out[name] = F.when(
            missed, F.raise_error(F.lit("quantile outside its bracket: raise the accuracy"))
        ).otherwise(lo + (hi - lo) * share)
    return _rejoin(stats, found, by).withColumns(out).select(*kept, *probs)


def median(df: DataFrame, value: str, by: list[str] | None = None, name: str = "median") -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, by)
