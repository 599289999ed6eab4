"""Sinks: feature tables, CSV reports, JSON result tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.guards import boundary_metrics
from tidemark.schema import DATE


def write_features(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_observed(
    df: DataFrame, path: str, anchor: str | dt.date, date: str = DATE, partition_by: list[str] | None = None
) -> dict[str, object]:
    """Write ``df`` and count on the way: rows, rows_after the anchor and the latest date.

    The counts come from the write itself, so the rows are neither read nor computed twice.
    """
    seen = Observation()
    write_features(df.observe(seen, *boundary_metrics(anchor, date)), path, partition_by)
    return seen.get


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV as a folder of part files, written in parallel."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


BOARD_SCHEMA = (
    "model string, task string, target string, metric string, score double, "
    "best_threshold double, precision double, recall double, accuracy double, roc_auc double, "
    "rmse double, r2 double, models_in_ensemble array<string>, "
    "threshold_curve struct<thresholds: array<double>, f1_scores: array<double>, "
    "precisions: array<double>, recalls: array<double>>"
)


def benchmark_payload(board: DataFrame, curves: DataFrame) -> DataFrame:
    """Leaderboard rows with their threshold curve folded into four arrays (one entry per cutoff)."""
    points = F.array_sort(F.collect_list(F.struct("threshold", "f1", "precision", "recall")))
    folded = curves.groupBy("model").agg(points.alias("c")).select(
        "model",
        F.lit("classification").alias("task"),
        F.struct(
            F.col("c.threshold").alias("thresholds"),
            F.col("c.f1").alias("f1_scores"),
            F.col("c.precision").alias("precisions"),
            F.col("c.recall").alias("recalls"),
        ).alias("threshold_curve"),
    )
    return board.join(folded, ["model", "task"], "left")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOARD_SCHEMA).json(path)
