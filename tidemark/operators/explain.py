"""Feature attributions: exact for linear scores, sampled Shapley values for any model."""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import cell
from tidemark.schema import KEY

PART_STEPS = 100_000
WORD = 60  # features in a long of bits


def linear_attribution(
    features: DataFrame,
    coefficients: dict[str, float],
    means: dict[str, float],
    key: str = KEY,
) -> DataFrame:
    """(key, feature, contribution) rows with ``coef * (x - mean)``; unknown x counts as the mean."""
    items = [
        F.struct(
            F.lit(c).alias("feature"),
            F.coalesce(F.lit(float(w)) * (cell(c) - F.lit(float(means[c]))), F.lit(0.0)).alias(
                "contribution"
            ),
        )
        for c, w in coefficients.items()
    ]
    return features.select(key, F.inline(F.array(*items)))


def top_attributions(attributions: DataFrame, k: int = 10, key: str = KEY) -> DataFrame:
    """The ``k`` largest contributions by size for each entity, ranked.

    An entity has one row per feature, so its list is bounded by the feature count.
    """
    item = F.struct(
        (-F.abs(F.col("contribution"))).alias("v"), F.col("feature"), F.col("contribution")
    )
    packed = attributions.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("a"))
    return packed.select(key, F.posexplode(F.slice("a", 1, k)).alias("i", "s")).select(
        key,
        (F.col("i") + 1).alias("rank"),
        F.col("s.feature").alias("feature"),
        F.col("s.contribution").alias("contribution"),
    )


def global_attribution(attributions: DataFrame, k: int = 20) -> DataFrame:
    """Mean size of each feature's contribution, the ``k`` largest first."""
    means = attributions.groupBy("feature").agg(
        F.avg(F.abs(F.col("contribution"))).alias("mean_abs")
    )
    return means.orderBy(F.desc("mean_abs"), F.asc("feature")).limit(k)


def _bits(inside: list[Column], word: int) -> Column:
    """Whether features are in a set, those from ``word * WORD`` to the next word's first, as bits of a long."""
    own = [F.when(x, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, x in enumerate(inside[word * WORD : (word + 1) * WORD])]
    return reduce(lambda a, x: a.bitwiseOR(x), own)


def sampled_shapley(
    features: DataFrame,
    columns: list[str],
    background: dict[str, object],
    score: Callable[[DataFrame], DataFrame],
    samples: int = 16,
    key: str = KEY,
    prob: str = "prob",
) -> DataFrame:
    """Permutation-sampled Shapley values of any scorer, for features of any type.

    For each entity and sample the features enter in a pseudo-random order, fixed by a hash
    of (key, pair of samples, feature); the second sample of a pair takes the reverse order,
    which cancels much of the error.  After ``j`` entries the first ``j`` features show the
    entity's value, the others the background's (null where it names none).  A set of entered
    features is scored once per entity, however many samples come past it (``samples`` is rounded up to pairs).  The step's score
    counts for the feature that just entered and against the one entering next, so the sum
    per feature needs no ordering of rows.  Contributions of one entity add up to its score
    minus the background's; ``std_error`` is that of the mean over pairs.

    Entities are dealt once, in parts of about ``PART_STEPS`` steps: sets, scores and sums of
    an entity all stay in its part, so only the entities themselves are shuffled.
    """
    m, pairs = len(columns), -(-samples // 2)
    types = {f.name: f.dataType for f in features.schema}
    parts = max(-(-features.count() * 2 * pairs * (m + 1) // PART_STEPS), features.sparkSession.sparkContext.defaultParallelism)
    # One column for all features: the join of sets and entities is whole-stage code of few columns.
    own = F.struct(*[cell(c).alias(f"f{i}") for i, c in enumerate(columns)])
    features = features.select(key, own.alias("_own")).repartition(parts, key)
    drawn = F.transform(
        F.array_sort(
            F.array(*[F.struct(F.xxhash64(cell(key), F.col("_s"), F.lit(i)).alias("h"), F.lit(i).cast("short").alias("i")) for i in range(m)])
        ),
        lambda e: e["i"],
    )
    walks = features.select(key, F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("_s")).select(
        key, "_s", drawn.alias("_order")
    )
    # Where each feature comes in an order.
    placed = F.transform(
        F.array_sort(F.transform("_order", lambda x, at: F.struct(x.alias("i"), at.cast("short").alias("at")))), lambda e: e["at"]
    )
    steps = (
        walks.select(key, "_s", F.explode(F.array("_order", F.reverse("_order"))).alias("_order"))
        .select(key, "_s", "_order", placed.alias("_at"))
        .select(key, "_s", "_order", "_at", F.explode(F.sequence(F.lit(0), F.lit(m))).alias("_j"))
    )
    # What a step's score counts for: the feature that just entered and, with the bits of its
    # number turned, the one entering next.  The lambdas here and below also keep these projections out of
    # whole-stage code: its one method for all features is too long for the JVM to compile.
    place = lambda i: F.col("_s") * m + F.get("_order", i)
    ends = F.array(F.when(F.col("_j") > 0, place(F.col("_j") - 1)), F.when(F.col("_j") < m, F.bitwise_not(place(F.col("_j")))))
    credit = F.filter(ends, lambda x: x.isNotNull())
    inside = [F.get("_at", F.lit(i)) < F.col("_j") for i in range(m)]
    bits = [f"_bits{w}" for w in range(-(-m // WORD))]
    sets = (
        steps.select(key, credit.alias("_credit"), *[_bits(inside, w).alias(b) for w, b in enumerate(bits)])
        .groupBy(key, *bits)
        .agg(F.collect_list("_credit").alias("_credits"))  # as many as the entity's walks at most
        .join(features.hint("shuffle_hash"), key)
    )

    def shown_value(i: int, c: str) -> Column:
        base = F.lit(background.get(c)).cast(types[c])
        own = F.col("_own")[f"f{i}"]
        # A missing number is imputed and so shows the background; a missing text is a level of its own.
        own = F.coalesce(own, base) if isinstance(types[c], T.NumericType) else own
        return F.when(F.col(f"_bits{i // WORD}").bitwiseAND(F.lit(1 << i % WORD).cast("long")) != 0, own).otherwise(base)

    mixed = {c: shown_value(i, c) for i, c in enumerate(columns)}
    shown = sets.select(key, F.array_sort(F.flatten("_credits")).alias("_credits"), *[v.alias(c) for c, v in mixed.items()])
    signed = F.transform(
        "_credits",
        lambda x: F.struct(F.when(x < 0, F.bitwise_not(x)).otherwise(x).alias("at"), F.when(x < 0, -1.0).otherwise(1.0).alias("sign")),
    )
    # No set is without credits; a plain inline() would put a filter for that between the scorer's projections.
    credits = (
        score(shown)
        .select(key, signed.alias("_credits"), cell(prob).alias("_p"))
        .select(key, "_p", F.inline_outer("_credits"))
        .select(key, "at", (F.col("sign") * F.col("_p")).alias("v"))
    )
    names = F.array(*[F.lit(c) for c in columns])
    return (
        credits.groupBy(key, "at")
        .agg((F.sum("v") / 2).alias("v"))
        .groupBy(key, (F.col("at") % m).cast("int").alias("i"))
        .agg(F.avg("v").alias("contribution"), (F.stddev_samp("v") / F.sqrt(F.lit(float(pairs)))).alias("std_error"))
        .select(key, names[F.col("i")].alias("feature"), "contribution", "std_error")
    )
