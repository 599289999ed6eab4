"""Helpers shared by the text operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path, settle

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
RELEASE_S = 10  # seconds between two releases of the driver's memory while steps are stored
_released = -float("inf")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    return stored_at(df, label)[0]


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``stored`` and the folder it is in, for a table that is to be discarded."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    release(df.sparkSession, RELEASE_S)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_path`` named, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession, every: float = 0) -> bool:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects its garbage, which may be long after a large step.
    The driver's heap shrinks to what is in use, and freed native memory goes back as well.
    ``every``: not within so many seconds of the last time.  Returns whether it was done.
    """
    global _released
    if time.monotonic() - _released < every:
        return False
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)
    _released = time.monotonic()
    return True


def trim(spark: SparkSession) -> bool:
    """Give native memory that the driver's JVM has freed back to the system.

    Compiling plans and the threads of broadcasts and exchanges leave it in the allocator's pools,
    where it stays.  False where the JVM has no such command (before Java 17.0.9, other than Linux).
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # Called by way of the interface: the server's own class is not open to Py4J.
        invoke = next(x for x in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if x.getName() == "invoke")
        values = array(jvm.java.lang.Object, 4)
        values[0], values[1] = bean, "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return False
    return True


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_array(text: Column) -> Column:
    """Words between ASCII white space; an empty array for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_RUN)
    )


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often it is used.

    An expression used inside a lambda would otherwise be evaluated for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def by_group(
    df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], list[tuple]], schema: str
) -> DataFrame:
    """Apply ``fn(key, rows)`` to every group of ``keys`` in one pass over sorted partitions.

    Only one group is held at a time, so groups have to be bounded by their key.
    """
    names = [p.strip().rsplit(" ", 1)[0] for p in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key: tuple | None = None
        out: list[tuple] = []
        for pdf in batches:
            if pdf.empty:
                continue
            changed = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            changed[0] = True
            cuts = [*changed.nonzero()[0], len(pdf)]
            for a, b in zip(cuts, cuts[1:]):
                part = pdf.iloc[a:b]
                k = tuple(part[keys].iloc[0])
                if key is not None and k != key:
                    out.extend(fn(key, pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                key = k
                held.append(part)
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if key is not None:
            out.extend(fn(key, pd.concat(held) if len(held) > 1 else held[0]))
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b long): one row (node, label), label the
    smallest node reachable.  Labels take their neighbours' minimum and then jump to
    their label's label, so long chains settle in few rounds; each round is stored.
    """
    both = stored(
        links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links"
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")
    ), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("mid")
        )
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = stored(
            lower.join(jump, "mid").select(
                "node", F.least("mid", "far").alias("label"), "was"
            ),
            "labels",
        )
        if moved.where("label <> was").limit(1).count() == 0:
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def text_hash() -> Column:
    """Hash of a row's text, null as empty: what a row is known by beside its doc_id."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, **keys: Column) -> DataFrame:
    """Rows of ``docs`` that ``gone`` does not name; ``keys`` are its columns and what they equal in a row.

    Nulls equal each other.  ``gone`` is broadcast if it is small.
    """
    side = settle(gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]).distinct())
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"_own_{k}").eqNullSafe(F.col(f"_gone_{k}"))
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(f"_own_{k}") for k, c in keys.items()])
    return rows.join(F.broadcast(side.df) if side.small else side.df, same, "left_anti").select("row.*")


def one_per_row(docs: DataFrame) -> DataFrame:
    """``docs`` with rows of equal doc_id and text only once; null ids equal each other.

    Only rows that occur more than once are looked at; the others pass without a shuffle.
    """
    keys = {"id": F.col("doc_id"), "hash": text_hash()}
    twice = stored(
        docs.select(*[c.alias(k) for k, c in keys.items()]).groupBy("id", "hash").agg(F.count("*").alias("n")).where("n > 1"),
        "twice",
    )
    if twice.limit(1).count() == 0:
        return docs
    same = F.col("_own_id").eqNullSafe(F.col("id")) & (F.col("_own_hash") == F.col("hash"))
    own = docs.select(F.struct("*").alias("row"), *[c.alias(f"_own_{k}") for k, c in keys.items()])
    again = own.join(twice, same, "left_semi").dropDuplicates(["_own_id", "_own_hash"]).select("row.*")
    return without(docs, twice, **keys).unionByName(again)
