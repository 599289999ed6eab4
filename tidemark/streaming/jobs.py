"""Streaming forms of the batch steps: daily roll-up, sliding features, gate, scoring."""

from __future__ import annotations

import datetime as dt
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions import cell
from tidemark.operators.guards import boundary_metrics, within_boundary
from tidemark.schema import KEY
from tidemark.sources.files import is_folder

GATE = "gate"  # name of the gate's observed metrics


def read_stream(
    spark: SparkSession, path: str, schema: StructType, ts: str = "ts"
) -> DataFrame:
    """Parquet folder or single file as a stream; event time as TIMESTAMP, as a watermark needs."""
    reader = spark.readStream.schema(schema)
    if is_folder(spark, path):
        raw = reader.parquet(path)
    else:  # a file stream watches folders, so a single file is picked by name
        folder, name = path.rsplit("/", 1)
        raw = reader.option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn(ts, cell(ts).cast("timestamp"))


def _rolled(df: DataFrame, window, value: str, key: str, ts: str, late: str) -> DataFrame:
    x = cell(value)
    return (
        df.withWatermark(ts, late)
        .groupBy(window.alias("w"), key)
        .agg(
            F.count(x).alias("n"), F.avg(x).alias("mean"), F.sum(x).alias("total"),
            F.min(x).alias("low"), F.max(x).alias("high"),
        )
        .select(
            key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean",
            "total", "low", "high",
        )
    )


def daily_rollup(
    df: DataFrame, value: str, key: str = KEY, ts: str = "ts", late: str = "2 days"
) -> DataFrame:
    """One row per entity and day; state is dropped once a day is ``late`` behind."""
    return _rolled(df, F.window(ts, "1 day"), value, key, ts, late)


def sliding_features(
    df: DataFrame, value: str, days: int, key: str = KEY, ts: str = "ts", late: str = "2 days"
) -> DataFrame:
    """Trailing ``days`` window, refreshed daily."""
    return _rolled(df, F.window(ts, f"{days} days", "1 day"), value, key, ts, late)


def run_available(
    df: DataFrame, path: str, checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Process what there is into a Parquet folder, then stop."""
    q = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def run_upserts(df: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Process what there is in update mode: the latest state of every window, open or closed.

    A batch writes the windows it changed to its own partition and overwrites only that,
    so a replayed batch changes nothing; of each window the last batch counts.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch", F.lit(batch_id).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(path)
        )

    q = (
        df.writeStream.foreachBatch(keep)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    schema = T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])
    rest = [c for c in df.columns if c not in keys]
    rows = df.sparkSession.read.schema(schema).parquet(path)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return latest.select(*keys, "last.*").select(*df.columns)


def gate(
    df: DataFrame,
    anchor: str | dt.date,
    accepted: str,
    quarantine: str,
    checkpoint: str,
    date: str = "date",
) -> StreamingQuery:
    """Rows up to the anchor go on, later ones to quarantine.

    Both folders are partitioned by batch and a batch overwrites only its own
    partition, so a replayed batch leaves each row once.  The counts of ``boundary_metrics``
    are observed as the rows come in; ``gate_metrics`` reads them.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for part, path in zip(within_boundary(batch, anchor, date), (accepted, quarantine)):
                (
                    part.withColumn("batch", F.lit(batch_id))
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("batch")
                    .parquet(path)
                )
        finally:
            batch.unpersist()

    q = (
        df.observe(GATE, *boundary_metrics(anchor, date)).writeStream.foreachBatch(split)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return q


def gate_metrics(query: StreamingQuery) -> dict[str, object]:
    """rows, rows_after and latest over all batches that ``query`` remembers (spark.sql.streaming.numRecentProgressUpdates)."""
    seen = [p.observedMetrics[GATE] for p in query.recentProgress if GATE in p.observedMetrics]
    # Progress reports carry dates as text.
    dates = [dt.date.fromisoformat(str(m["latest"])[:10]) for m in seen if m["latest"] is not None]
    return {
        "rows": sum(m["rows"] for m in seen),
        "rows_after": sum(m["rows_after"] for m in seen),
        "latest": max(dates, default=None),
    }


def score_stream(
    features: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    cutoff: float,
    path: str,
    checkpoint: str,
    key: str = KEY,
) -> StreamingQuery:
    """Continuous scoring: the fold models are stateless transforms, so rows stream through."""
    p = F.col("prob")
    out = score(features).select(
        key,
        "prob",
        F.when(p >= cutoff, "High Risk").otherwise("Low Risk").alias("status"),
    )
    return run_available(out, path, checkpoint)
