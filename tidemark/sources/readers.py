"""Raw tables: header CSV in any accepted spelling, canonical typed columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import as_anchor, cell, day_of, parse_moment
from tidemark.schema import (
    ANCHOR,
    DATE,
    DEFAULT_ANCHOR,
    KEY,
    MISSING_TOKENS,
    TABLES,
    Headers,
)
from tidemark.sources.files import exists, raw_path


def scan_csv(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Header CSV as text columns, the usual missing-value tokens as null.

    Nothing is inferred: types are applied per canonical column.  Quoted line breaks
    need ``multiline``, which gives up splitting single files.
    """
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(path)
    )
    return raw.select(
        *[F.when(~cell(c).isin(MISSING_TOKENS), cell(c)).alias(c) for c in raw.columns]
    )


def entity_key(text: Column) -> Column:
    """Integer key; a missing or malformed one fails the job."""
    whole = text.try_cast("bigint")
    loose = text.try_cast("double")
    key = F.coalesce(whole, F.when(loose == F.floor(loose), F.floor(loose)))
    return F.when(key.isNull(), F.raise_error(F.lit("entity key missing or not an integer"))).otherwise(
        key
    )


def _typed(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.DateType):
        return day_of(text)
    number = text.try_cast("double")
    number = F.when(~F.isnan(number), number)
    return number.cast("int") if isinstance(kind, T.IntegerType) else number


def canonical(
    raw: DataFrame,
    name: str,
    default_anchor: str | None = DEFAULT_ANCHOR,
    aliases: dict[str, list[str]] | None = None,
    keep_extra: bool = False,
) -> DataFrame:
    """Typed canonical columns of one raw table; columns it lacks stay absent."""
    spec = TABLES[name]
    headers = Headers(raw.columns, aliases)
    picked: list[Column] = []
    picked.append(entity_key(cell(headers.need(KEY))).alias(KEY))
    if spec.stamp:
        stamp = cell(headers.need("activity_date"))
        if spec.stamp == "datetime":
            picked.append(parse_moment(stamp).alias("datetime"))
        picked.append(day_of(stamp).alias(DATE))
    for col, (logical, kind) in spec.columns.items():
        found = headers.take(logical)
        if found is not None:
            value = _typed(cell(found), kind)
            if col == ANCHOR and default_anchor is not None:
                value = F.coalesce(value, as_anchor(default_anchor))
            picked.append(value.alias(col))
        elif col == ANCHOR:
            if default_anchor is None:
                raise KeyError("labels carry no observation end and no default anchor was given")
            picked.append(as_anchor(default_anchor).alias(col))
    if keep_extra:
        picked += [cell(c) for c in headers.left]
    return raw.select(*picked)


def load_table(
    spark: SparkSession,
    folder: str,
    name: str,
    default_anchor: str | None = DEFAULT_ANCHOR,
    aliases: dict[str, list[str]] | None = None,
    keep_extra: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """One canonical table; a missing optional file is an empty table of its schema.

    ``multiline`` is for files whose quoted texts hold line breaks.
    """
    spec = TABLES[name]
    path = raw_path(spark, folder, spec.file_key)
    if not exists(spark, path):
        if spec.required_file:
            raise FileNotFoundError(f"{name} expected at {path}")
        return spark.createDataFrame([], spec.schema)
    return canonical(scan_csv(spark, path, multiline), name, default_anchor, aliases, keep_extra)


def load_raw(
    spark: SparkSession,
    folder: str,
    default_anchor: str | None = DEFAULT_ANCHOR,
    aliases: dict[str, list[str]] | None = None,
    multiline: bool | list[str] = False,
) -> dict[str, DataFrame]:
    """All seven tables, lazily; ``multiline`` for all of them or for those named."""
    broken = (lambda n: n in multiline) if isinstance(multiline, list) else (lambda n: multiline)
    return {n: load_table(spark, folder, n, default_anchor, aliases, multiline=broken(n)) for n in TABLES}


IMPORTANCE_SCHEMA = "feature string, importance double"


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMPORTANCE_SCHEMA).option("header", True).csv(path)


def read_oof(spark: SparkSession, path: str, models: list[str]) -> DataFrame:
    probs = ", ".join(f"`prob_{m}` double" for m in models)
    schema = f"{KEY} bigint, y_true_injured int, {probs}"
    return spark.read.schema(schema).option("header", True).csv(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def feature_source(
    spark: SparkSession,
    build,
    precomputed: str | None = None,
    raw_dir: str | None = None,
    default: str | None = None,
) -> DataFrame:
    """Features from the first source there is: a given file, raw tables, the default file."""
    if precomputed and exists(spark, precomputed):
        return read_features(spark, precomputed)
    if raw_dir and exists(spark, raw_dir):
        return build(load_raw(spark, raw_dir))
    if default and exists(spark, default):
        return read_features(spark, default)
    raise FileNotFoundError("neither precomputed features nor raw tables were found")


def preview(df: DataFrame, n: int = 100) -> tuple[DataFrame, int, int]:
    """First rows of a table with its row and column counts."""
    return df.limit(n), df.count(), len(df.columns)
