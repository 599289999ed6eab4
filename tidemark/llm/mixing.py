"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, repeated up to ``epochs``
times.  A document's virtual finish time is its source's words served up to and including
it, divided by the source's target; served by that clock, all sources reach their target
together, at time 1, and the total budget is used up there.  The schedule is range-sorted
by finish time; a document in service when the budget ends is taken up to the words it has
been served until then.

Nothing is gathered per source: running totals come from about sqrt(rows) hash buckets, so
a source with a third of all rows is spread over as many tasks, and documents travel as
(id, size) without their text.

Null texts have size 0, are never taken and change nothing.  A null source is a source of
its own, after all others.  Repeated rows are documents of their own (equal rows follow
each other in the order).  An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import one_per_row, stored, word_count
from tidemark.operators.ordering import global_rank
from tidemark.session import join_checked, settle

EPOCHS = 3
CYCLE = (1.0, 2.0, 3.0)


def fair_targets(sources: DataFrame, budget: int, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to (source key, source_size, weight): the budget shared by weight.

    A target stops at ``epochs`` times its source's size and the excess is shared anew by
    weight among the others, until none is above.  Each round is one aggregate over the
    sources of which two numbers reach the driver.
    """
    cap = F.col("source_size") * float(epochs)
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        got = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("capped"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, True)).alias("n"),
        ).first()
        if got["n"] == stopped or got["open"] == 0:
            break
        stopped = got["n"]
        level = (budget - got["capped"]) / got["open"]
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def cycling_weights(sources: DataFrame) -> DataFrame:
    """Weights 1, 2, 3, repeating, by the sources' code point order, null last."""
    ranked = global_rank(sources, [F.col("no_source"), F.col("source_key")], "rank")
    turn = F.pmod(F.col("rank") - 1, F.lit(len(CYCLE))).cast("int")
    return ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), turn + 1)).drop("rank")


def schedule(
    docs: DataFrame,
    weights: DataFrame | None = None,
    size: Column | None = None,
    epochs: int = EPOCHS,
    seed: int = 7,
    budget: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, text_hash, source, size, source_size, target, taken, served, finish.

    ``weights`` (source, weight) replaces the cycling weights.  ``served`` is the words of
    its source before the document in one epoch, ``finish`` the virtual time at which its
    last taken word is served (null if none is).
    """
    measure = word_count(F.col("text").cast("string")) if size is None else size
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long"),
            F.col("source").cast("string").alias("source"),
            F.col("source").isNull().alias("no_source"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"),
            measure.cast("long").alias("size"),
            F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
        ),
        "mix-sizes",
    )
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    budget = whole["words"] if budget is None else budget
    buckets = max(1, math.isqrt(whole["n"]))
    # Buckets are ranges of the draw: the order does not depend on their number.
    head = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(head * buckets / float(2**32)).cast("long"))
    key = ["no_source", "source_key"]

    sources = rows.groupBy(*key).agg(F.sum("size").alias("source_size"))
    if weights is None:
        weighed = cycling_weights(sources)
    else:
        given = weights.select(
            F.col("source").isNull().alias("no_source"),
            F.coalesce("source", F.lit("")).alias("source_key"),
            F.col("weight").cast("double").alias("weight"),
        )
        weighed = sources.join(given, key, "left").fillna(0.0, ["weight"])
    targets = settle(fair_targets(stored(weighed, "mix-sources"), budget, epochs))

    per_bucket = rows.groupBy(*key, "bucket").agg(F.sum("size").alias("words"))
    earlier = W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = per_bucket.select(*key, "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = W.partitionBy(*key, "bucket").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        join_checked(rows, settle(starts), [*key, "bucket"], even=True)
        .withColumn("served", F.col("start") + F.sum("size").over(inside) - F.col("size"))
        .drop("start")
    )
    timed = join_checked(placed, targets, key)
    goal = F.floor(F.col("target"))
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0))
    rest = goal - F.col("passes") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("served")))
    done = F.when(part > 0, F.col("passes") * F.col("source_size") + F.col("served") + part).when(
        F.col("passes") > 0, (F.col("passes") - 1) * F.col("source_size") + F.col("served") + F.col("size")
    )
    return (
        timed.withColumn("passes", passes.cast("long"))
        .withColumn("rest", rest)
        .withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))
        .withColumn("finish", F.when(F.col("taken") > 0, done / F.col("target")))
        .select("doc_id", "text_hash", "source", "size", "source_size", "target", "taken", "served", "finish")
    )


def serve(scheduled: DataFrame) -> DataFrame:
    """The mix itself: one row per document and epoch in serving order, cut at the budget.

    Adds ``epoch`` (from 0), ``epoch_words`` (words taken in it) and ``epoch_finish``, the
    virtual finish time by which the rows are range-sorted over all sources.
    """
    epochs = F.sequence(F.lit(0), F.floor((F.col("target") - F.col("served") - 1) / F.col("source_size")).cast("int"))
    begin = F.col("epoch") * F.col("source_size") + F.col("served")
    words = F.least(F.col("size"), F.floor("target") - begin)
    return (
        scheduled.where("taken > 0")
        .withColumn("epoch", F.explode(epochs))
        .withColumn("epoch_words", words)
        .where("epoch_words > 0")
        .withColumn("epoch_finish", (begin + F.col("epoch_words")) / F.col("target"))
        .orderBy("epoch_finish", "source", "doc_id")
    )


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, size, source_size, target, taken, served and finish of every document.

    Range-sorted by finish time, what is not taken last.
    """
    return schedule(docs, **options).drop("source", "text_hash").orderBy(F.col("finish").asc_nulls_last(), "doc_id")


def taken_rows(docs: DataFrame, **options: object) -> DataFrame:
    """Rows of ``docs`` that the mix takes, with all their columns and mix_size,
    mix_source_size, mix_target, mix_taken and mix_finish.

    Rows of equal id and text count once.
    """
    own = one_per_row(docs)
    plan = schedule(own, **options).where("taken > 0").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"),
        F.struct(*[F.col(c).alias(f"mix_{c}") for c in ("size", "source_size", "target", "taken", "finish")]).alias("mix"),
    )
    rows = own.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"),
    )
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    return rows.join(plan, same).select("row.*", "mix.*")
