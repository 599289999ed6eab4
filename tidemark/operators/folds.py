"""Group-disjoint folds, balanced by rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cell
from tidemark.operators.guards import LeakageError
from tidemark.operators.ordering import running_totals
from tidemark.schema import KEY
from tidemark.session import durable, join_checked, settle


def _deal(loads: list[int], size: int, count: int) -> tuple[list[int], list[list[int]]]:
    """How ``count`` groups of ``size`` rows go, one by one, to the fold that is lightest then.

    Returns (starts, orders): from the starts[i]-th group on the folds of orders[i] take
    turns.  A fold joins the turns once the others have reached its load, so there are at
    most as many entries as folds, however many groups are dealt.  ``loads`` is updated.
    """
    waiting = sorted(range(len(loads)), key=lambda f: (loads[f], f))
    active = [waiting.pop(0)]
    starts, orders, dealt = [], [], 0
    while dealt < count:
        active.sort(key=lambda f: (loads[f], f))
        room = count - dealt
        if waiting:
            top, name = loads[waiting[0]], waiting[0]
            # Turns before the next fold is the lightest: a tie goes to the lower number.
            turns = [max(0, -(-(top - loads[f] + (f < name)) // size)) for f in active]
            room = min(room, sum(turns))
        if room:
            starts.append(dealt)
            orders.append(list(active))
            for i, f in enumerate(active):
                loads[f] += size * (room // len(active) + (i < room % len(active)))
            dealt += room
        if waiting:
            active.append(waiting.pop(0))
    return starts, orders


def group_folds(df: DataFrame, k: int = 5, key: str = KEY) -> DataFrame:
    """(key, rows, fold) with every group in one fold and folds of nearly equal rows.

    Groups go largest first, equal ones in key order, to the fold that has the fewest rows
    then: fold sizes differ by one group at most, and k groups fill k folds.  The driver
    deals a histogram of group sizes (at most sqrt(2 * rows) entries, since the sizes add up
    to the rows); a group looks up its turn by its running rank among groups of its size.
    """
    sizes = durable(
        df.where(cell(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    )
    histogram = sizes.groupBy("rows").agg(F.count("*").alias("n")).orderBy(F.desc("rows")).collect()
    groups = sum(r["n"] for r in histogram)
    if groups < k:
        raise ValueError(f"{k} folds need at least {k} groups, found {groups}")
    loads = [0] * k
    dealt = [(r["rows"], r["n"], *_deal(loads, r["rows"], r["n"])) for r in histogram]
    schema = "rows long, _count long, _starts array<long>, _orders array<array<int>>"
    turns = df.sparkSession.createDataFrame(dealt, schema)
    ranked = running_totals(sizes, [F.asc(key)], {"_turn": F.lit(1)}, by=["rows"])
    met = join_checked(ranked, settle(turns), ["rows"], sizes="_count")
    turn = F.col("_turn") - 1
    part = F.size(F.filter("_starts", lambda s: s <= turn)) - 1
    order = F.get("_orders", part)
    fold = F.get(order, F.pmod(turn - F.get("_starts", part), F.size(order)).cast("int"))
    return met.select(key, "rows", fold.alias("fold"))


def inner_ranks(folds: DataFrame, classes: DataFrame, key: str = KEY, seed: int = 42) -> DataFrame:
    """(key, rows, fold, _class, _dealt): running rank of every group within its fold and class.

    ``classes`` has (key, _class).  The order is that of a hash of seed and key.
    """
    drawn = F.md5(F.concat(F.lit(f"inner-{seed}:"), cell(key).cast("string")))
    rows = folds.join(classes, key).withColumn("_drawn", drawn)
    return running_totals(rows, [F.asc("_drawn"), F.asc(key)], {"_dealt": F.lit(1)}, by=["fold", "_class"]).drop("_drawn")


def inner_fold(counts: dict[tuple[int, int], int], side: int, parts: int) -> Column:
    """Inner fold of a group on the training side of fold ``side``, from ``inner_ranks``.

    ``counts`` are the groups per (fold, class).  Ranks within a fold are moved behind those
    of the side's earlier folds: each class is dealt round over the whole side, and its
    groups per inner fold differ by at most one.
    """
    start = F.lit(0).cast("long")
    for (fold, cls) in counts:
        before = sum(n for (f, c), n in counts.items() if c == cls and f < fold and f != side)
        start = F.when((F.col("fold") == fold) & (F.col("_class") == cls), F.lit(before).cast("long")).otherwise(start)
    return F.pmod(F.col("_dealt") - 1 + start, F.lit(parts)).cast("int")


def with_folds(df: DataFrame, folds: DataFrame, key: str = KEY) -> DataFrame:
    """Rows with their group's fold and what else the fold table (one row per group) says."""
    if "rows" in folds.columns:
        return join_checked(df, folds.withColumnRenamed("rows", "_rows"), [key], sizes="_rows")
    return join_checked(df, folds.select(key, "fold"), [key])


def fold_report(tagged: DataFrame, k: int = 5, key: str = KEY) -> DataFrame:
    """Entities and rows on the training and validation side of every fold, and overlap."""
    per_key = tagged.groupBy(key, "fold").agg(F.count("*").alias("n"))
    by_fold = per_key.groupBy("fold").agg(
        F.count("*").alias("entities"), F.sum("n").alias("rows")
    )
    spread = per_key.groupBy(key).agg(F.count("*").alias("folds"), F.collect_set("fold").alias("f"))
    all_ = per_key.agg(F.sum("n").alias("r"))
    keys = spread.agg(F.count("*").alias("e"))
    over = (
        spread.where(F.col("folds") > 1)
        .select(F.explode("f").alias("fold"))
        .groupBy("fold")
        .agg(F.count("*").alias("overlap"))
    )
    rows, ents = F.broadcast(all_), F.broadcast(keys)  # one row each
    return (
        by_fold.join(over, "fold", "left")
        .withColumn("_o", F.lit(1))
        .join(rows.withColumn("_o", F.lit(1)), "_o")
        .join(ents.withColumn("_o", F.lit(1)), "_o")
        .select(
            "fold",
            (F.col("e") - F.col("entities") + F.coalesce("overlap", F.lit(0))).alias(
                "train_entities"
            ),
            (F.col("r") - F.col("rows")).alias("train_rows"),
            F.col("entities").alias("val_entities"),
            F.col("rows").alias("val_rows"),
            F.coalesce("overlap", F.lit(0)).alias("overlap"),
        )
    )


def fold_overlap(tagged: DataFrame, key: str = KEY) -> DataFrame:
    """Keys that sit in more than one fold; empty when the folds are disjoint."""
    return (
        tagged.select(key, "fold").distinct().groupBy(key).agg(F.count("*").alias("folds"))
        .where(F.col("folds") > 1)
    )


def assert_folds_disjoint(tagged: DataFrame, key: str = KEY) -> None:
    bad = [r[0] for r in fold_overlap(tagged, key).take(5)]
    if bad:
        raise LeakageError(f"'{key}' values in several folds, for example {bad}")
