"""Data-quality audits: nulls, duplicates, impossible numbers, whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import cell, numeric_columns
from tidemark.schema import DATE, KEY


def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))


def _missing(df: DataFrame, c: str) -> Column:
    x = cell(c)
    return (x.isNull() | F.isnan(x)) if _is_float(df, c) else x.isNull()


def _null_structs(df: DataFrame) -> list[Column]:
    rows = F.count(F.lit(1))
    out = []
    for c in df.columns:
        n = F.count_if(_missing(df, c))
        pct = F.bround(F.try_divide(n * F.lit(100.0), rows), 2)
        out.append(
            F.struct(
                F.lit(c).alias("column"), n.alias("missing_count"), pct.alias("missing_percentage")
            )
        )
    return out


def null_audit(df: DataFrame) -> DataFrame:
    """Columns with missing values, most missing first: one aggregate for all columns."""
    one = df.agg(F.array(*_null_structs(df)).alias("a"))
    return (
        one.select(F.inline("a"))
        .where(F.col("missing_count") > 0)
        .orderBy(F.desc("missing_count"), F.asc("column"))
    )


def duplicate_count(df: DataFrame, subset: list[str], name: str = "duplicates") -> DataFrame:
    """Rows beyond the first of each key.  Unknown columns are ignored; no column means 0."""
    keys = [c for c in subset if c in df.columns]
    if not keys:
        return df.limit(0).agg(F.lit(0).cast("long").alias(name))
    sizes = df.groupBy(*[cell(k) for k in keys]).agg(F.count("*").alias("_n"))
    return sizes.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias(name))


def _anomaly_structs(df: DataFrame, columns: list[str]) -> list[Column]:
    out = []
    for c in columns:
        x = F.when(~_missing(df, c), cell(c)).cast("double")
        out.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("_n"),
                F.count_if(x < 0).alias("negative_count"),
                F.count_if(F.abs(x) == F.lit(float("inf"))).alias("infinite_count"),
                F.min(x).alias("min_val"),
                F.max(x).alias("max_val"),
            )
        )
    return out


def anomaly_audit(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Negative and infinite counts, minimum and maximum of each numeric column with values."""
    numeric = numeric_columns(df)
    chosen = [c for c in (columns or numeric) if c in numeric]
    one = df.agg(F.array(*_anomaly_structs(df, chosen)).alias("a"))
    return one.select(F.inline("a")).where(F.col("_n") > 0).drop("_n")


def duplicate_key(table: str, columns: list[str], key: str = KEY, date: str = DATE) -> list[str]:
    if table == "training_sessions" and "session_id" in columns:
        return ["session_id"]
    return [key, date] if key in columns and date in columns else [key]


def table_audit(
    tables: dict[str, DataFrame],
    key: str = KEY,
    date: str = DATE,
    dup_keys: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One report row per table: size, entities, duplicates, missing columns and details.

    Each table is read once.  Rows are summed per duplicate key and entity first; these sums
    carry counts, gaps, anomalies and ends of every column, and the report merges them.
    """
    reports = []
    for name, df in tables.items():
        wanted = (dup_keys or {}).get(name) or duplicate_key(name, df.columns, key, date)
        subset = [c for c in wanted if c in df.columns]
        held = [key] if key in df.columns else []
        numeric = numeric_columns(df)
        sums = [F.count(F.lit(1)).alias("_rows"), *[F.count_if(_missing(df, c)).alias(f"_m{i}") for i, c in enumerate(df.columns)]]
        for i, c in enumerate(numeric):
            x = F.when(~_missing(df, c), cell(c)).cast("double")
            sums += [
                F.count(x).alias(f"_n{i}"),
                F.count_if(x < 0).alias(f"_neg{i}"),
                F.count_if(F.abs(x) == F.lit(float("inf"))).alias(f"_inf{i}"),
                F.min(x).alias(f"_min{i}"),
                F.max(x).alias(f"_max{i}"),
            ]
        keys = list(dict.fromkeys([*subset, *held]))
        named = df.select("*", *[cell(k).alias(f"_k{i}") for i, k in enumerate(keys)])
        per_key = named.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(*sums)
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        place = {k: F.col(f"_k{i}") for i, k in enumerate(keys)}
        # Without an entity beside the duplicate key, every row of ``per_key`` is a key of its own.
        distinct = F.count(F.lit(1)) if set(held) <= set(subset) else F.count_distinct(F.struct(*[place[c] for c in subset]))
        rows = total("_rows")
        missing = [
            F.struct(
                F.lit(c).alias("column"),
                total(f"_m{i}").alias("missing_count"),
                F.bround(F.try_divide(total(f"_m{i}") * F.lit(100.0), rows), 2).alias("missing_percentage"),
            )
            for i, c in enumerate(df.columns)
        ]
        numbers = [
            F.struct(
                F.lit(c).alias("column"),
                total(f"_n{i}").alias("_n"),
                total(f"_neg{i}").alias("negative_count"),
                total(f"_inf{i}").alias("infinite_count"),
                F.min(f"_min{i}").alias("min_val"),
                F.max(f"_max{i}").alias("max_val"),
            )
            for i, c in enumerate(numeric)
        ]
        none = F.expr(
            "cast(array() as array<struct<column:string,_n:bigint,negative_count:bigint,"
            "infinite_count:bigint,min_val:double,max_val:double>>)"
        )
        body = per_key.agg(
            rows.alias("rows"),
            (F.count_distinct(place[key]) if held else F.lit(0).cast("long")).alias("unique_entities"),
            (rows - distinct if subset else F.lit(0).cast("long")).alias("duplicates"),
            F.array(*missing).alias("missing"),
            (F.array(*numbers) if numbers else none).alias("numbers"),
        )
        found = F.filter("missing", lambda m: m["missing_count"] > 0)
        kept = F.transform(F.filter("numbers", lambda a: a["_n"] > 0), lambda a: a.dropFields("_n"))
        reports.append(
            body.select(
                F.lit(name).alias("table"),
                F.when(F.col("rows") > 0, "OK").otherwise("EMPTY_OR_NOT_FOUND").alias("status"),
                "rows",
                F.lit(len(df.columns)).alias("columns"),
                "unique_entities",
                F.size(found).alias("missing_columns_count"),
                found.alias("missing_summary"),
                kept.alias("anomalies"),
                "duplicates",
            )
        )
    return reduce(lambda a, b: a.unionByName(b), reports)
