"""Interaction audit of a set of filters by relations of failing ids.

Every row of ``documents`` gets an id of its own.  The ids of the rows that fail a filter are
stored per filter, and those of all rows beside them.  These tables and all that follow from
them are bucketed by id, so every join below runs inside a bucket and shuffles nothing.

An order of filters removes what its prefixes remove, and a prefix removes the same rows in
any order of its filters, so 120 orders have only 31 prefixes.  For each of them

* its survivors are those of the prefix one shorter, left-anti joined with the failing ids of
  the filter added; they are stored, one table for all prefixes of a length;
* what next filters remove are their failing ids, left-semi joined with the survivors;
* what is redundant for them are their failing ids, left-anti joined with the survivors.

Counts and label losses are sums over these relations per part; the rows per order, step and
part only look them up.

Null texts are empty texts, and a null source is the part ''.  A null doc_id is no smaller
doc_id and has none smaller; it has no labels.  Repeated rows are documents of their own, and
equal ids do not fail each other.  Repeated labels count as one that holds every mark.
"""

from __future__ import annotations

import uuid
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER, discard, let, stored, word_array
from tidemark.session import join_checked, scratch_path, settle

FILTERS = "ABCDE"
BUCKET_ROWS = 1_000_000
MIN_BUCKETS, MAX_BUCKETS = 8, 100_000  # the upper one is Spark's own


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that need a document's own text only."""
    size = F.char_length(text)
    upper = size - F.char_length(F.translate(text, UPPER, ""))
    counts = let(word_array(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    return {
        "words": counts,
        "C": 100 * upper.cast("long") > 2 * size.cast("long"),
        "D": F.rlike(text, F.lit("[#$%&*|]")),
    }


def judged_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row_id, part, good, toxic and a flag per filter, one row per row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("text_hash"),
        *[c.alias(n) for n, c in text_failures(text).items()],
    )
    judged = stored(
        plain.select(
            "row_id",
            "doc_id",
            "part",
            "text_hash",
            (F.col("words.n") < 200).alias("A"),
            (100 * F.col("words.d").cast("long") < 50 * F.col("words.n").cast("long")).alias("B"),
            "C",
            "D",
        ),
        "audit-rows",
    )
    # A text many rows have is a hot key: its row is repeated once per salt.
    twice = (
        judged.groupBy("text_hash")
        .agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows"))
        .where("n_rows > 1 and first is not null")
    )
    known = join_checked(judged, settle(twice), ["text_hash"], "left", sizes="n_rows")
    marks = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        .where("good or toxic")
    )
    own = F.coalesce("doc_id", -1 - F.col("row_id"))  # rows without an id do not meet in one task
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return (
        known.withColumn("id", own)
        .withColumn("has_id", F.col("doc_id").isNotNull())
        .join(marks.withColumn("has_id", F.lit(True)), ["id", "has_id"], "left")
        .select(
            "row_id",
            "part",
            flag("good"),
            flag("toxic"),
            *"ABCD",
            F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"),
        )
    )


class Relations:
    """Id tables bucketed by row_id, in one folder and under names that go with it."""

    def __init__(self, df: DataFrame, label: str, buckets: int):
        self.spark, self.buckets = df.sparkSession, buckets
        self.folder = scratch_path(self.spark, label)
        self.tag = f"{label.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
        self.names: list[str] = []

    def deal(self, df: DataFrame) -> DataFrame:
        """Rows dealt out as the buckets are, so a task writes one bucket."""
        return df.repartition(self.buckets, "row_id").coalesce(self.buckets)

    def keep(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """Store ``df``, one relation per value of ``by``."""
        full = f"{self.tag}_{name}"
        (
            df.write.format("parquet")
            .partitionBy(by)
            .bucketBy(self.buckets, "row_id")
            .option("path", f"{self.folder}/{full}")
            .saveAsTable(full)
        )
        self.names.append(full)
        return self.spark.table(full)

    def drop(self) -> None:
        for n in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
        discard(self.spark, self.folder)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def prefix_counts(judged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, kind, filter, before, n, good, toxic for every set of filters applied before.

    ``kind`` is kept (survivors of ``before``; no filter), removed or redundant.
    """
    judged = stored(judged, "audit-judged")
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, -(-judged.count() // BUCKET_ROWS)))
    tables = Relations(judged, "audit-ids", buckets)
    ids = ["row_id", "part", "good", "toxic"]
    failed = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in filters]))
    fails = tables.keep(tables.deal(judged.select(*ids, F.explode(failed).alias("filter"))), "fails", "filter")
    # A prefix without filters is "-": an empty name is no folder.
    alive = tables.keep(tables.deal(judged.select(*ids, F.lit("-").alias("before"))), "alive_0", "before")
    levels = []
    for many in range(len(filters) + 1):
        prefixes = ["".join(x) for x in combinations(filters, many)] if many else ["-"]
        if many:
            kept = [
                alive.where(F.col("before") == (p[:-1] or "-"))
                .hint("merge")
                .join(fails.where(F.col("filter") == p[-1]).select("row_id"), "row_id", "left_anti")
                .select(*ids, F.lit(p).alias("before"))
                for p in prefixes
            ]
            alive = tables.keep(_all(kept), f"alive_{many}", "before")
        kept = alive.withColumns({"kind": F.lit("kept"), "filter": F.lit("")})
        relations = [kept.select("part", "good", "toxic", "kind", "filter", "before")]
        for p in prefixes:
            others = [f for f in filters if f not in p]
            if others:
                asked = fails.where(F.col("filter").isin(others)).hint("merge")
                living = alive.where(F.col("before") == p).select("row_id")
                for kind, how in (("removed", "left_semi"), ("redundant", "left_anti")):
                    gone = asked.join(living, "row_id", how)
                    relations.append(gone.select("part", "good", "toxic", F.lit(kind), "filter", F.lit(p)))
        level = (
            _all(relations)
            .groupBy("part", "kind", "filter", "before")
            .agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
        )
        levels.append(stored(level, "audit-counts"))
    out = stored(_all(levels), "audit-counts")
    tables.drop()
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley (removals of the step's filter, summed over all orders).
    """
    counts = prefix_counts(judged_rows(docs, labels), filters)
    key = F.concat_ws("/", "kind", "filter", "before")
    # At most three times 80 entries a part, however many documents it has.
    per_part = counts.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(key, F.struct("n", "good", "toxic")))).alias("found")
    )

    def look(kind: str, f: Column, before: Column, of: str = "n") -> Column:
        before = F.when(before == "", "-").otherwise(before)
        entry = F.try_element_at("found", F.concat_ws("/", F.lit(kind), f, before))
        return F.coalesce(entry[of], F.lit(0)).cast("long")

    steps = [
        (order, i + 1, f, "".join(sorted(order[:i])), "".join(sorted(order[: i + 1])))
        for order in map("".join, permutations(sorted(filters)))
        for i, f in enumerate(order)
    ]
    # Constants as one parsed text: thousands of single ones take the driver seconds.
    table = F.expr(
        "array("
        + ", ".join(
            f"named_struct('filter_order', '{o}', 'step', {i}, 'f', '{f}', 'before', '{b}', 'after', '{a}')"
            for o, i, f, b, a in steps
        )
        + ")"
    )

    def removed(f: str, before: str) -> str:
        return f"coalesce(try_element_at(found, 'removed/{f}/{before or '-'}').n, 0L)"

    full, shapley, unique = len(filters) - 1, [], []
    for f in sorted(filters):
        others = "".join(x for x in sorted(filters) if x != f)
        sets = ["".join(s) for k in range(len(others) + 1) for s in combinations(others, k)]
        terms = [f"{factorial(len(s)) * factorial(full - len(s))} * {removed(f, s)}" for s in sets]
        shapley.append(f"'{f}', {' + '.join(terms)}")
        unique.append(f"'{f}', {removed(f, others)}")
    wide = per_part.select(
        "part",
        "found",
        F.expr(f"map({', '.join(shapley)})").alias("shapley"),
        F.expr(f"map({', '.join(unique)})").alias("unique"),
    )
    rows = wide.select("part", "found", "shapley", "unique", F.explode(table).alias("s"))
    f, before = F.col("s.f"), F.col("s.before")
    return rows.select(
        "part",
        F.col("s.filter_order").alias("filter_order"),
        F.col("s.step").alias("step"),
        look("kept", F.lit(""), F.col("s.after")).alias("kept"),
        look("removed", f, before).alias("removed"),
        look("redundant", f, before).alias("redundant"),
        F.element_at("unique", f).alias("unique_fails"),
        look("removed", f, before, "good").alias("good_lost"),
        look("removed", f, before, "toxic").alias("toxic_lost"),
        F.element_at("shapley", f).cast("long").alias("shapley"),
    )
