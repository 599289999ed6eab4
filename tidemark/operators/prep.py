"""Design matrix: median imputation, scaling and one-hot encoding, fit on training rows only.

The statistics of all training sides come from sums per fold: a side is all folds but one,
so its numbers are those sums without the fold's own.  What is fitted is a persistable
pipeline of built-in stages.  Columns with few levels carry them in the pipeline; the levels
of wide columns stay in a distributed dictionary, and the pipeline knows their number only.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import cell, numeric_columns
from tidemark.operators.describe import long_form
from tidemark.operators.ordering import running_totals
from tidemark.session import join_checked, settle

NULL_LEVEL = "nan"  # text level that stands for a missing category
WIDE_LEVELS = 10_000  # columns with more levels are encoded through a dictionary
WHOLE = -1  # fold number of statistics over all rows
GRID = 500  # quantiles per fold and column that bracket the medians
ACCURACY = 2_000


@dataclass
class PrepStats:
    """Fitted numbers of one training set: bounded by the number of columns and WIDE_LEVELS."""

    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    wide: dict[str, int] = field(default_factory=dict)  # number of levels


def _below(q: list[float], n: int, v: float) -> float:
    """At most so many of a fold's ``n`` values are smaller than ``v``."""
    i = bisect_left(q, v)
    return n if i >= len(q) else min(n, (i / GRID + 1 / ACCURACY) * n + 1)


def _upto(q: list[float], n: int, v: float) -> float:
    """At least so many of a fold's ``n`` values are ``v`` or smaller."""
    i = bisect_right(q, v) - 1
    return 0 if i < 0 else n if v >= q[-1] else max(0, (i / GRID - 1 / ACCURACY) * n - 1)


def median_bracket(parts: list[tuple[list[float], int]]) -> tuple[float, float]:
    """Two values that enclose the median of the union of ``parts``.

    A part is (GRID + 1 quantiles in order, first and last exact, number of values).
    """
    n = sum(m for _, m in parts)
    low, high = (n - 1) // 2, n // 2
    seen = sorted({v for q, _ in parts for v in q})
    a, b = 0, len(seen) - 1
    while a < b:  # the last value with few enough below it
        mid = (a + b + 1) // 2
        a, b = (mid, b) if sum(_below(q, m, seen[mid]) for q, m in parts) <= low else (a, mid - 1)
    first, b = a, len(seen) - 1
    while a < b:  # the first value with enough up to it
        mid = (a + b) // 2
        a, b = (a, mid) if sum(_upto(q, m, seen[mid]) for q, m in parts) >= high + 1 else (mid + 1, b)
    return seen[first], seen[a]


def _medians(
    rows: DataFrame, sums: dict[str, dict[int, Row]], folds: list[int], sides: dict[int, list[int]]
) -> dict[tuple[int, str], float]:
    """Exact median of every column on every side, from counts per fold inside one bracket per column."""
    brackets, below = [], {}
    for c, per in sums.items():
        ends = []
        for own in sides.values():
            parts = [([per[f]["low"], *per[f]["q"][1:-1], per[f]["high"]], per[f]["known"]) for f in own if f in per]
            if parts:
                ends.append(median_bracket(parts))
        if ends:
            brackets.append((c, min(a for a, _ in ends), max(b for _, b in ends)))
    if not brackets:
        return {}
    edges = rows.sparkSession.createDataFrame(brackets, "feature string, _lo double, _hi double")
    x = F.col("value")
    # One row per column: bounded by the number of columns.
    met = rows.join(F.broadcast(edges), "feature").where(x <= F.col("_hi"))
    inside = F.when(x >= F.col("_lo"), x)
    counts = met.groupBy("feature", inside.alias("_v")).agg(*[F.count_if(F.col("fold") == f).alias(f"_n{f}") for f in folds])
    summed = running_totals(
        counts, [F.asc_nulls_first("_v")], {f"_c{f}": F.col(f"_n{f}") for f in folds}, by=["feature"]
    )
    picks, wanted = [], {}
    for s, own in sides.items():
        upto = sum((F.col(f"_c{f}") for f in own), F.lit(0))
        n = {c: sum(per[f]["known"] for f in own if f in per) for c, per in sums.items()}
        at = F.create_map(*[x for c, m in n.items() for x in (F.lit(c), F.lit(m))])[F.col("feature")]
        for side, place in (("l", F.floor((at - 1) / 2)), ("h", F.floor(at / 2))):
            picks.append(F.min(F.when(upto > place, F.col("_v"))).alias(f"{side}{s}"))
        wanted[s] = n
    out = {}
    for r in summed.groupBy("feature").agg(*picks).collect():  # one row per column
        for s in sides:
            if wanted[s][r["feature"]]:
                out[s, r["feature"]] = (r[f"l{s}"] + r[f"h{s}"]) / 2
    return out


def _numbers(base: DataFrame, nums: list[str], folds: list[int], sides: dict[int, list[int]], out: dict[int, PrepStats]) -> None:
    cols = [cell(c).cast("double").alias(c) for c in nums]
    rows = long_form(base.select("fold", *cols), nums, ["fold"])
    x = F.when(~F.isnan("value"), F.col("value"))
    grid = [i / GRID for i in range(GRID + 1)]
    first = rows.groupBy("feature", "fold").agg(
        F.count("*").alias("rows"),
        F.count(x).alias("known"),
        F.avg(x).alias("mean"),
        F.var_pop(x).alias("var"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
        F.percentile_approx(x, grid, ACCURACY).alias("q"),
    )
    sums: dict[str, dict[int, Row]] = {}
    totals: dict[tuple[str, int], int] = {}
    for r in first.collect():  # one row per column and fold
        totals[r["feature"], r["fold"]] = r["rows"]
        if r["known"]:
            sums.setdefault(r["feature"], {})[r["fold"]] = r
    known = rows.select("fold", "feature", x.alias("value")).where("value is not null")
    medians = _medians(known, sums, folds, sides)
    for (s, c), med in medians.items():
        parts = [sums[c][f] for f in sides[s] if f in sums[c]]
        n = sum(totals.get((c, f), 0) for f in sides[s])
        k = sum(r["known"] for r in parts)
        mean = sum(r["known"] * r["mean"] for r in parts) / k
        var = sum(r["known"] * (r["var"] + (r["mean"] - mean) ** 2) for r in parts) / k
        filled = (k * mean + (n - k) * med) / n
        spread = (k * (var + (mean - filled) ** 2) + (n - k) * (med - filled) ** 2) / n
        out[s].medians[c], out[s].means[c], out[s].stds[c] = med, filled, math.sqrt(spread)


def _text(c: str) -> Column:
    return F.coalesce(cell(c).cast("string"), F.lit(NULL_LEVEL))


def _levels(base: DataFrame, cats: list[str], sides: dict[int, list[int]], out: dict[int, PrepStats], wide: int) -> None:
    text = base.select("fold", *[_text(c).alias(c) for c in cats])
    found = settle(
        text.unpivot(["fold"], cats, "feature", "level")
        .groupBy("feature", "level")
        .agg(F.collect_set("fold").alias("folds"))
    )
    sizes = {r["feature"]: r["n"] for r in found.df.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    narrow = [c for c in cats if sizes.get(c, 0) <= wide]
    rows = found.df.where(F.col("feature").isin(narrow)).orderBy("feature", "level").collect()  # at most ``wide`` a column
    for s, own in sides.items():
        for r in rows:
            if set(own) & set(r["folds"]):
                out[s].levels.setdefault(r["feature"], []).append(r["level"])
        out[s].wide = {c: sizes[c] for c in cats if sizes.get(c, 0) > wide}


def fit_stats(
    df: DataFrame, columns: list[str], folds: list[int] | None = None, wide: int = WIDE_LEVELS
) -> dict[int, PrepStats]:
    """Statistics per training side; ``folds`` None means one fit over all rows.

    No row is repeated per side: rows are summed per fold, and levels carry their folds.
    """
    sides = {WHOLE: [0]} if folds is None else {s: [f for f in folds if f != s] for s in folds}
    every = [0] if folds is None else list(folds)
    out = {s: PrepStats() for s in sides}
    nums = [c for c in numeric_columns(df) if c in columns]
    cats = [c for c in columns if c not in nums]
    base = df.withColumn("fold", F.lit(0)) if folds is None else df
    if nums:
        _numbers(base, nums, every, sides, out)
    if cats:
        _levels(base, cats, sides, out, wide)
    order = {c: i for i, c in enumerate(columns)}
    for s in out.values():
        s.medians = dict(sorted(s.medians.items(), key=lambda kv: order[kv[0]]))
        s.levels = dict(sorted(s.levels.items(), key=lambda kv: order[kv[0]]))
        s.wide = dict(sorted(s.wide.items(), key=lambda kv: order[kv[0]]))
    return out


def level_dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, level, slot, rows): every level of every column, numbered in name order from 0.

    A running count over level ranges: no task and no driver holds a column's levels.
    """
    text = df.select(*[_text(c).alias(c) for c in columns])
    counts = text.unpivot([], columns, "feature", "level").groupBy("feature", "level").agg(F.count("*").alias("rows"))
    ranked = running_totals(counts, [F.asc("level")], {"_n": F.lit(1)}, by=["feature"])
    return ranked.select("feature", "level", (F.col("_n") - 1).alias("slot"), "rows")


def slot_column(c: str) -> str:
    return f"_slot_{c}"


def with_slots(df: DataFrame, dictionary: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Rows with the slot of each wide column's level; a level the dictionary lacks has the slot after the last.

    The dictionary is joined by size: broadcast where it is small, else with its frequent
    levels salted.
    """
    out = df
    for c, n in columns.items():
        name = slot_column(c)
        side = dictionary.where(F.col("feature") == c).select(F.col("level").alias("_level"), F.col("slot").alias(name), "rows")
        out = join_checked(out.withColumn("_level", _text(c)), side.withColumnRenamed("rows", "_lrows"), ["_level"], "left", "_lrows")
        out = out.drop("_level").withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(float(n))))
    return out


def one_hot_sparse(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, size, slots): the places of the ones in each row's one-hot vector, however many levels there are.

    Columns follow each other in the vector, levels in name order; ``key`` is unique.
    """
    dictionary = level_dictionary(df, columns)
    sizes = {r["feature"]: r["n"] for r in dictionary.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    start, place = F.lit(0).cast("long"), 0
    for c in columns:
        start = F.when(F.col("feature") == c, F.lit(place).cast("long")).otherwise(start)
        place += sizes.get(c, 0)
    rows = df.select(cell(key), *[_text(c).alias(f"_t_{c}") for c in columns])
    long = rows.withColumnsRenamed({f"_t_{c}": c for c in columns if c != key}).unpivot(
        [key], [c if c != key else f"_t_{c}" for c in columns], "feature", "level"
    )
    met = join_checked(long, dictionary, ["feature", "level"], sizes="rows")
    # A key has one slot per column: the list is as long as there are columns.
    slots = F.sort_array(F.collect_list(start + F.col("slot")))
    return met.groupBy(key).agg(F.lit(place).cast("long").alias("size"), slots.alias("slots"))


def _num(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def build_prep(df: DataFrame, stats: PrepStats, scale: bool, output: str = "features") -> PipelineModel:
    """Persistable stages for one set of statistics; ``df`` supplies the schema only."""
    exprs = []
    for c, med in stats.medians.items():
        e = f"coalesce(nanvl(CAST({_quoted(c)} AS DOUBLE), NULL), {_num(med)})"
        if scale:
            std = stats.stds[c] or 1.0
            e = f"({e} - {_num(stats.means[c])}) / {_num(std)}"
        exprs.append(f"{e} AS {_quoted('_n_' + c)}")
    for c in stats.levels:
        exprs.append(f"coalesce(CAST({_quoted(c)} AS STRING), '{NULL_LEVEL}') AS {_quoted('_c_' + c)}")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")]
    cats = list(stats.levels)
    if cats:
        # The known levels as a small table: one row per level, short columns padded.
        widest = max(len(v) for v in stats.levels.values())
        rows = [tuple(v[min(i, len(v) - 1)] for v in stats.levels.values()) for i in range(widest)]
        known = df.sparkSession.createDataFrame(rows, [f"_c_{c}" for c in cats])
        indexer = StringIndexer(
            inputCols=[f"_c_{c}" for c in cats],
            outputCols=[f"_i_{c}" for c in cats],
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        )
        stages.append(indexer.fit(known))
        # The kept slot for unseen levels is the one dropped: unseen becomes all zeros.
        encoder = OneHotEncoder(
            inputCols=[f"_i_{c}" for c in cats],
            outputCols=[f"_o_{c}" for c in cats],
            dropLast=True,
        )
        empty = df.sparkSession.createDataFrame([], T.StructType(df.schema.fields))
        seen = PipelineModel(stages).transform(empty)
        stages.append(encoder.fit(seen))  # reads the level counts from the column metadata
    inputs = [f"_n_{c}" for c in stats.medians] + [f"_o_{c}" for c in cats]
    if stats.wide:
        # Slots come with the rows; the encoder learns their number from the column's metadata.
        slots = [slot_column(c) for c in stats.wide]
        sized = df.sparkSession.createDataFrame([], T.StructType([T.StructField(x, T.DoubleType()) for x in slots])).select(
            *[
                F.col(x).alias(x, metadata={"ml_attr": {"type": "nominal", "num_vals": n + 1, "name": x}})
                for x, n in zip(slots, stats.wide.values())
            ]
        )
        wide = OneHotEncoder(inputCols=slots, outputCols=[f"_w_{c}" for c in stats.wide], dropLast=True)
        stages.append(wide.fit(sized))
        inputs += [f"_w_{c}" for c in stats.wide]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return PipelineModel(stages)


def feature_names(stats: PrepStats) -> list[str]:
    """Names of the vector's places; those of wide columns carry the slot in place of the level."""
    return [
        *stats.medians,
        *[f"{c}_{v}" for c, vs in stats.levels.items() for v in vs],
        *[f"{c}#{i}" for c, n in stats.wide.items() for i in range(n)],
    ]


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with nulls replaced by their exact median."""
    s = fit_stats(df.select(*[cell(c) for c in columns]), columns)[WHOLE]
    return df.withColumns(
        {c: F.coalesce(cell(c).cast("double"), F.lit(s.medians[c])) for c in s.medians}
    )


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """Imputed columns minus their mean over their population deviation."""
    s = fit_stats(df.select(*[cell(c) for c in columns]), columns)[WHOLE]
    out = {}
    for c, med in s.medians.items():
        x = F.coalesce(cell(c).cast("double"), F.lit(med))
        out[c] = (x - F.lit(s.means[c])) / F.lit(s.stds[c] or 1.0)
    return df.withColumns(out)


def one_hot(df: DataFrame, columns: list[str]) -> DataFrame:
    """One 0/1 column per level, levels in name order; a null is its own level."""
    s = fit_stats(df.select(*[cell(c) for c in columns]), columns)[WHOLE]
    made = {}
    for c, levels in s.levels.items():
        text = F.coalesce(cell(c).cast("string"), F.lit(NULL_LEVEL))
        made.update({f"{c}_{v}": (text == v).cast("int") for v in levels})
    rest = [cell(c) for c in df.columns if c not in s.levels]
    return df.select(*rest, *[v.alias(n) for n, v in made.items()])
