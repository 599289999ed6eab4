"""The engine's canonical tables, derived from the star-schema tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR_DAY = dt.date(2024, 1, 23)
ORDERS_ANCHOR = dt.date(2000, 6, 30)
EVENT_WEIGHTS = {"purchase": 1.5, "signup": 1.4, "click": 1.1}
EVENT_PATTERNS = {
    "practice_sessions_30d": "click",
    "scrimmage_sessions_30d": "signup",
    "gym_sessions_30d": "purchase",
}


# Declared, so that planning reads no file footers.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("date", F.col("ts").cast("date"))


def _of(*kinds: str):
    return F.sum(F.when(F.col("event_type").isin(*kinds), F.col("value")))


def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .groupBy(F.col("user_id").alias("athlete_id"), "date")
        .agg(
            F.sum("value").alias("steps"),
            F.count("*").cast("double").alias("distance"),
            _of("purchase").alias("calories"),
            _of("click").alias("very_active_minutes"),
            _of("view").alias("fairly_active_minutes"),
            _of("signup").alias("lightly_active_minutes"),
            F.count_if(F.col("event_type") == "error").cast("double").alias("sedentary_minutes"),
        )
    )


def hourly_heartrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and hour: mean, lowest and highest reading."""
    return (
        _events(spark, sf_dir)
        .groupBy(
            F.col("user_id").alias("athlete_id"),
            F.date_trunc("hour", F.col("ts")).alias("datetime"),
            "date",
        )
        .agg(
            F.avg("value").alias("heart_rate"),
            F.min("value").alias("min_heart_rate"),
            F.max("value").alias("max_heart_rate"),
        )
    )


def sleep_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _events(spark, sf_dir)
        .groupBy(F.col("user_id").alias("athlete_id"), "date")
        .agg(_of("view").alias("sleep_minutes"), _of("view", "click").alias("time_in_bed"))
    )


def training_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.hour("ts").cast("double")
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("session_id"),
        F.col("user_id").alias("athlete_id"),
        "date",
        F.col("event_type").alias("sport_session_type"),
        start.alias("start_hour"),
        (start + F.col("value") / 100).alias("end_hour"),
    )


def weight_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("athlete_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("log_id"),
        F.col("o_totalprice").alias("weight"),
    )


def athlete_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    joined = table(spark, sf_dir, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )
    return joined.select(
        F.col("c_custkey").alias("athlete_id"),
        F.col("c_mktsegment").alias("sport"),
        F.col("n_name").alias("team_id"),
        F.col("c_acctbal").alias("weight_kg_baseline"),
    )


def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive: an error above 100 in the week after the anchor."""
    e = _events(spark, sf_dir)
    hit = (
        (F.col("event_type") == "error")
        & (F.col("value") > 100)
        & (F.col("date") > F.lit(ANCHOR_DAY))
        & (F.col("date") <= F.date_add(F.lit(ANCHOR_DAY), 7))
    )
    return (
        e.groupBy(F.col("user_id").alias("athlete_id"))
        .agg(
            F.max(hit.cast("int")).alias("injured_in_risk_window"),
            F.min(F.when(hit, F.datediff("date", F.lit(ANCHOR_DAY)))).cast("double").alias(
                "onset_day_offset"
            ),
            (F.max(F.when(hit, F.col("value"))) / 20).alias("recovery_duration"),
        )
        .withColumn("obs_window_end", F.lit(ANCHOR_DAY))
    )


def own_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's own anchor: the day of the last purchase, without any the last day."""
    bought = F.max(F.when(F.col("event_type") == "purchase", F.col("date")))
    return (
        _events(spark, sf_dir)
        .groupBy(F.col("user_id").alias("athlete_id"))
        .agg(F.coalesce(bought, F.max("date")).alias("obs_window_end"))
    )


def own_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``train_labels``, each user at the own anchor."""
    e = _events(spark, sf_dir).withColumnRenamed("user_id", "athlete_id")
    met = e.join(own_anchors(spark, sf_dir), "athlete_id")
    off = F.datediff("date", "obs_window_end")
    hit = (F.col("event_type") == "error") & (F.col("value") > 100) & off.between(1, 7)
    return met.groupBy("athlete_id", "obs_window_end").agg(
        F.max(hit.cast("int")).alias("injured_in_risk_window"),
        F.min(F.when(hit, off)).cast("double").alias("onset_day_offset"),
        (F.max(F.when(hit, F.col("value"))) / 20).alias("recovery_duration"),
    )


def recent_weight_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``weight_logs`` with the days moved from the orders' anchor to that of the events."""
    by = (ANCHOR_DAY - ORDERS_ANCHOR).days
    return weight_logs(spark, sf_dir).withColumn("date", F.date_add("date", by))


def bundle(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "daily_activity": daily_activity(spark, sf_dir),
        "hourly_heartrate": hourly_heartrate(spark, sf_dir),
        "sleep_day": sleep_day(spark, sf_dir),
        "training_sessions": training_sessions(spark, sf_dir),
        "weight_logs": weight_logs(spark, sf_dir),
        "athlete_metadata": athlete_metadata(spark, sf_dir),
        "train_labels": train_labels(spark, sf_dir),
    }


def oof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table: three deterministic 'models' per labelled user.

    The score of window ``d`` is the user's mean error value over the last ``d``
    days up to the anchor, over 100, at most 1 (0 without any error).
    """
    e = _events(spark, sf_dir).where(
        (F.col("event_type") == "error") & (F.col("date") <= F.lit(ANCHOR_DAY))
    )
    scores = e.groupBy(F.col("user_id").alias("athlete_id")).agg(
        *[
            F.avg(F.when(F.col("date") >= F.date_sub(F.lit(ANCHOR_DAY), d - 1), F.col("value")))
            .alias(f"w{d}")
            for d in (7, 14, 30)
        ]
    )
    y = train_labels(spark, sf_dir).select(
        "athlete_id", F.col("injured_in_risk_window").alias("y_true")
    )
    wide = y.join(scores, "athlete_id", "left")
    long = wide.unpivot(["athlete_id", "y_true"], ["w7", "w14", "w30"], "model", "_mean")
    p = F.least(F.coalesce(F.round(F.col("_mean") / 100, 9), F.lit(0.0)), F.lit(1.0))
    return long.select("model", "athlete_id", "y_true", p.alias("prob"))
