"""Global ranks and running totals that never put the whole order into one task.

A sort already cuts the rows into ranges, one per partition.  The total of each
earlier range is a small table (one row per partition and group), so a row's
global position is that offset plus its position inside its own range.  The
sorted rows are made durable first: the ranges then stay the same however often
they are read, also after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import durable, join_checked

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits
_ROW_MASK = (1 << _ROW_BITS) - 1


def _cut_sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    return durable(placed.withColumn("_part", F.shiftright("_at", _ROW_BITS).cast("int")))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in the global order.

    ``order`` should end in a unique key: ties are then split over ranges as well.
    """
    rows = _cut_sorted(df, order)
    # One row per sort partition: bounded by the partition count, not by the data.
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit(_ROW_MASK)) + 1)
        .drop("_part", "_at", "_start")
    )


def running_totals(
    df: DataFrame, order: list[Column], totals: dict[str, Column], by: list[str] | None = None
) -> DataFrame:
    """Inclusive running sums along ``order``, restarted for each ``by`` group."""
    by = list(by or [])
    inputs = {f"_x{i}": c for i, c in enumerate(totals.values())}
    rows = _cut_sorted(
        df.withColumns(inputs), [*[F.col(f"`{b}`").asc() for b in by], *order]
    )
    per_range = rows.groupBy(*by, "_part").agg(*[F.sum(x).alias(f"_s{x}") for x in inputs])
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = per_range.select(
        *by,
        "_part",
        *[F.coalesce(F.sum(f"_s{x}").over(earlier), F.lit(0)).alias(f"_o{x}") for x in inputs],
    )
    inside = W.partitionBy(*by, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    out = join_checked(rows, starts, [*by, "_part"], even=True)
    return out.withColumns(
        {n: F.col(f"_o{x}") + F.sum(x).over(inside) for n, x in zip(totals, inputs)}
    ).drop("_part", "_at", *inputs, *[f"_o{x}" for x in inputs])
