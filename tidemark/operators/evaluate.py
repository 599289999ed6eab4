"""Scores against truth: threshold sweep, metrics, ROC, ensembles and leaderboards.

Score tables are long, ``(model, key, y_true, prob)``, so every operator takes
``by`` and handles all models in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import cell, meets, round4
from tidemark.operators.ordering import running_totals
from tidemark.schema import KEY
from tidemark.session import join_checked

FIRST_STEP, LAST_STEP = 5, 95  # default grid: 0.05, 0.06, ..., 0.95


def _default_slot(p: Column) -> Column:
    """Number of hundredths reached: the largest i with p >= i/100, settled by comparison."""
    i = F.floor(p * 100)
    up, here = (i + 1) / F.lit(100.0), i / F.lit(100.0)
    return F.when(p >= up, i + 1).when(p < here, i - 1).otherwise(i)


def threshold_curve(
    df: DataFrame,
    truth: str = "y_true",
    score: str = "prob",
    by: list[str] | None = None,
    grid: list[float] | None = None,
) -> DataFrame:
    """F1, precision and recall at every cutoff, from one pass over the scores.

    Scores fall into the bucket of the highest cutoff they reach; the counts at a
    cutoff are the sums over its bucket and all higher ones.
    """
    by = list(by or [])
    p, y = cell(score), cell(truth)
    if grid is None:
        first, steps = FIRST_STEP, LAST_STEP - FIRST_STEP + 1
        cuts = f"transform(sequence({first}, {LAST_STEP}), i -> i / 100.0D)"
        slot = _default_slot(p) - (first - 1)
    else:
        own = sorted(set(float(g) for g in grid))
        steps = len(own)
        cuts = f"array({', '.join(f'{c!r}D' for c in own)})"
        slot = F.size(F.filter(F.expr(cuts), lambda c: c <= p))
    slot = F.least(F.greatest(slot, F.lit(0)), F.lit(steps)).cast("int")
    pos, neg = (y == 1).cast("long"), (y != 1).cast("long")
    counts = (
        df.where(y.isNotNull())
        .groupBy(*by, slot.alias("slot"))
        .agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg"))
    )
    # At most one row per cutoff and model from here on.
    packed = counts.groupBy(*by).agg(
        F.collect_list(F.struct("slot", "pos", "neg")).alias("b"),
        F.sum("pos").alias("positives"),
    )

    def reach(b: Column, i: Column, field: str) -> Column:
        return F.aggregate(
            F.filter(b, lambda s: s["slot"] >= i),
            F.lit(0).cast("long"),
            lambda acc, s: acc + s[field],
        )

    rows = packed.select("*", F.posexplode(F.expr(cuts)).alias("i", "t")).select(
        *by,
        F.col("t").alias("threshold"),
        reach(F.col("b"), F.col("i") + 1, "pos").alias("tp"),
        reach(F.col("b"), F.col("i") + 1, "neg").alias("fp"),
        "positives",
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("positives") - tp
    zero = F.lit(0.0)
    return rows.select(
        *by,
        "threshold",
        F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), zero).alias("f1"),
        F.coalesce(F.try_divide(tp.cast("double"), tp + fp), zero).alias("precision"),
        F.coalesce(F.try_divide(tp.cast("double"), F.col("positives")), zero).alias("recall"),
    )


def best_threshold(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Highest F1, lowest cutoff among ties; 0.5 with zeros when no cutoff scores.

    Everything is rounded to four decimals, as the tuned cutoff is used that way.
    """
    rank = F.struct(F.col("f1"), -F.col("threshold"), F.col("precision"), F.col("recall"))
    top = curve.groupBy(*(by or [])).agg(F.max(rank).alias("b"))
    f1, t = F.col("b.f1"), -F.col("b.col2")
    hit = f1 > 0
    return top.select(
        *(by or []),
        F.when(hit, round4(t)).otherwise(0.5).alias("best_threshold"),
        F.when(hit, round4(f1)).otherwise(0.0).alias("best_f1"),
        F.when(hit, round4(F.col("b.precision"))).otherwise(0.0).alias("precision"),
        F.when(hit, round4(F.col("b.recall"))).otherwise(0.0).alias("recall"),
    )


def confusion_matrix(
    df: DataFrame, predicted: Column, truth: str = "y_true", by: list[str] | None = None
) -> DataFrame:
    """All four (actual, predicted) cells, zero cells included."""
    by = list(by or [])
    y = cell(truth)
    cells = [(a, b) for a in (0, 1) for b in (0, 1)]
    agg = df.groupBy(*by).agg(
        *[
            F.count_if((y == a) & (predicted == b)).alias(f"_{a}{b}")
            for a, b in cells
        ]
    )
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"),
                     F.col(f"_{a}{b}").alias("count"))
            for a, b in cells
        ]
    )
    return agg.select(*by, F.inline(rows))


def classification_metrics(
    df: DataFrame,
    predicted: Column,
    truth: str = "y_true",
    score: str | None = "prob",
    by: list[str] | None = None,
) -> DataFrame:
    """F1, precision, recall, accuracy and (with a score) ROC-AUC; four decimals."""
    by = list(by or [])
    y = cell(truth)
    # A row without a score reaches no cutoff: it counts as predicted 0, as in the curve.
    predicted = F.coalesce(predicted.cast("int"), F.lit(0))
    c = df.groupBy(*by).agg(
        F.count_if((y == 1) & (predicted == 1)).alias("tp"),
        F.count_if((y != 1) & (predicted == 1)).alias("fp"),
        F.count_if((y == 1) & (predicted != 1)).alias("fn"),
        F.count_if(y.isNotNull()).alias("n"),
    )
    tp, fp, fn, n = (F.col(x) for x in ("tp", "fp", "fn", "n"))
    zero = F.lit(0.0)

    def part(top: Column, bottom: Column) -> Column:
        return round4(F.coalesce(F.try_divide(top.cast("double"), bottom), zero))

    out = c.select(
        *by,
        part(2 * tp, 2 * tp + fp + fn).alias("f1"),
        part(tp, tp + fp).alias("precision"),
        part(tp, tp + fn).alias("recall"),
        part(n - fp - fn, n).alias("accuracy"),
    )
    if score is None:
        return out
    auc = roc_auc(df, truth, score, by).withColumn("roc_auc", round4(F.col("roc_auc")))
    if by:
        return out.join(auc, by)
    return out.withColumn("_o", F.lit(1)).join(auc.withColumn("_o", F.lit(1)), "_o").drop("_o")


def _score_steps(df: DataFrame, truth: str, score: str, by: list[str]) -> DataFrame:
    """Positives and negatives at or above each distinct score, highest first."""
    y = cell(truth)
    steps = (
        df.where(y.isNotNull())
        .groupBy(*by, cell(score).alias("threshold"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg"))
    )
    return running_totals(
        steps, [F.desc("threshold")], {"tp": F.col("pos"), "fp": F.col("neg")}, by
    )


def roc_points(
    df: DataFrame, truth: str = "y_true", score: str = "prob", by: list[str] | None = None
) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score; the origin has a null threshold."""
    by = list(by or [])
    steps = _score_steps(df, truth, score, by)
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if by:
        met = steps.join(totals, by)
    else:
        met = steps.withColumn("_o", F.lit(1)).join(totals.withColumn("_o", F.lit(1)), "_o")
    points = met.select(
        *by,
        "threshold",
        F.try_divide(F.col("fp").cast("double"), F.col("_n")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("_p")).alias("tpr"),
    )
    origin = totals.select(
        *by,
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return origin.unionByName(points)


def roc_auc(
    df: DataFrame, truth: str = "y_true", score: str = "prob", by: list[str] | None = None
) -> DataFrame:
    """Area under the ROC curve, ties counted half; 0 where one class is missing."""
    by = list(by or [])
    steps = _score_steps(df, truth, score, by)
    above = F.col("tp") - F.col("pos")
    won = F.col("neg") * (above + F.col("pos") / 2.0)
    out = steps.groupBy(*by).agg(
        F.sum(won).alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    )
    area = F.try_divide(F.col("_w"), F.col("_p").cast("double") * F.col("_n"))
    return out.select(*by, F.coalesce(area, F.lit(0.0)).alias("roc_auc"))


def regression_metrics(
    df: DataFrame, truth: str, predicted: str, by: list[str] | None = None
) -> DataFrame:
    """MAE, RMSE and r² over rows that have both values; four decimals."""
    y, p = cell(truth).cast("double"), cell(predicted).cast("double")
    e = y - p
    both = F.when(e.isNotNull(), y)
    agg = df.groupBy(*(by or [])).agg(
        F.avg(F.abs(e)).alias("_mae"),
        F.avg(e * e).alias("_mse"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(both) * F.count(both)).alias("_sst"),
        F.count(both).alias("_n"),
    )
    r2 = F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_sst"))
    flat = F.when(F.col("_sse") == 0, 1.0).otherwise(0.0)  # a constant truth
    return agg.select(
        *(by or []),
        round4(F.col("_mae")).alias("mae"),
        round4(F.sqrt("_mse")).alias("rmse"),
        round4(F.when(F.col("_n") > 1, F.coalesce(r2, flat))).alias("r2"),
    )


def residual_pairs(df: DataFrame, truth: str, predicted: str, key: str = KEY) -> DataFrame:
    return df.select(
        key,
        cell(truth).alias("actual"),
        cell(predicted).alias("predicted"),
        (cell(predicted) - cell(truth)).alias("residual"),
    )


def ensemble_mean(
    scores: DataFrame, models: list[str], name: str = "Top3_Ensemble", key: str = KEY
) -> DataFrame:
    """Mean probability of the chosen models, as one more model of the score table."""
    return (
        scores.where(F.col("model").isin(*models))
        .groupBy(key, "y_true")
        .agg(F.avg("prob").alias("prob"))
        .select(F.lit(name).alias("model"), key, "y_true", "prob")
    )


def top_models(best: DataFrame, order: list[str], k: int = 3) -> list[str]:
    """Names of the ``k`` best F1 scores; the earlier candidate wins a tie.

    ``best`` has one row per candidate model.
    """
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    rows = best.where(F.col("model").isin(*order)).orderBy(F.desc("best_f1"), place).limit(k)
    return [r["model"] for r in rows.select("model").collect()]


def oof_wide(scores: DataFrame, models: list[str], key: str = KEY) -> DataFrame:
    """One row per entity: truth and one probability column per model."""
    out = scores.groupBy(key, F.col("y_true").alias("y_true_injured")).pivot("model", models).agg(
        F.first("prob")
    )
    return out.select(
        key, "y_true_injured", *[cell(m).alias(f"prob_{m}") for m in models]
    )


def leaderboard(parts: list[DataFrame]) -> DataFrame:
    """One table of all tasks' results; fields a task lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _place(order: list[str] | None) -> Column:
    """Place of a model in candidate order; those it does not name come after, by name."""
    if not order:
        return F.lit(0)
    place = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return F.when(place > 0, place).otherwise(F.lit(len(order) + 1))


def best_per_task(board: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Winner of each task: highest F1, or lowest error; the earlier candidate wins a tie."""
    value = F.when(F.col("metric") == "F1", -F.col("score")).otherwise(F.col("score"))
    pick = F.min(F.struct(value.alias("v"), _place(order).alias("p"), "model", "score", "metric"))
    return board.groupBy("task").agg(pick.alias("b")).select(
        "task", F.col("b.model").alias("model"), F.col("b.metric").alias("metric"),
        F.col("b.score").alias("score"),
    )


def board_kpis(board: DataFrame) -> DataFrame:
    """Best F1 and best MAE per task."""
    return board.groupBy("task", "metric").agg(
        F.count("*").alias("models"), F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
    )


def model_comparison(board: DataFrame) -> DataFrame:
    """Scores side by side: one row per model, one column per task."""
    tasks = ["classification", "onset", "recovery"]
    return board.groupBy("model").pivot("task", tasks).agg(F.first("score"))


def ranked_board(board: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rank within each task, F1 falling and errors rising, ties in candidate order (a few rows per task)."""
    value = F.when(F.col("metric") == "F1", -F.col("score")).otherwise(F.col("score"))
    w = W.partitionBy("task").orderBy(value, _place(order), "model")
    return board.withColumn("place", F.row_number().over(w))


def apply_cutoffs(scores: DataFrame, cutoffs: DataFrame, on: list[str]) -> DataFrame:
    """Attach each model's tuned cutoff (one row per model) and the 0/1 decision."""
    met = join_checked(scores, cutoffs.select(*on, "best_threshold"), on)
    return met.withColumn("predicted", meets(F.col("prob"), F.col("best_threshold")))
