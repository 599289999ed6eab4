"""Candidate models, calibration, out-of-fold scoring and importances.

Every fit is a distributed MLlib job.  The loops over models and folds run on the
driver; out-of-fold rows stay DataFrames and are unioned.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Callable

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import cell, clip
from tidemark.operators.folds import (
    assert_folds_disjoint,
    group_folds,
    inner_fold,
    inner_ranks,
    with_folds,
)
from tidemark.operators.prep import (
    WHOLE,
    PrepStats,
    build_prep,
    feature_names,
    fit_stats,
    level_dictionary,
    slot_column,
    with_slots,
)
from tidemark.operators.score import fold_mean
from tidemark.schema import KEY
from tidemark.session import durable, scratch_path

FEATURES = "features"
LABEL = "_y"
INNER_FOLDS = 3


@dataclass(frozen=True)
class Candidate:
    """A model family: how to make the estimator and which output carries its margin."""

    name: str
    make: Callable[[dict[str, Any]], Any]
    scaled: bool = False
    margin: str = "raw"


def classifiers(seed: int = 42, overrides: dict[str, dict] | None = None) -> list[Candidate]:
    """Boosted trees, bagged trees and L2 logistic regression, in candidate order."""
    own = overrides or {}

    def gbt(ctx: dict) -> GBTClassifier:
        p = dict(maxIter=150, maxDepth=4, stepSize=0.05, subsamplingRate=0.8,
                 featureSubsetStrategy="0.8", seed=seed)
        return GBTClassifier(**{**p, **own.get("GBT", {})})

    def forest(ctx: dict) -> RandomForestClassifier:
        p = dict(numTrees=150, maxDepth=6, minInstancesPerNode=2, seed=seed)
        return RandomForestClassifier(**{**p, **own.get("RandomForest", {})})

    def logistic(ctx: dict) -> LogisticRegression:
        # Penalty 0.5*w² against C*sum(loss): per-row weight 1/(C*n).
        p = dict(regParam=1.0 / (0.5 * max(ctx["n"], 1)), elasticNetParam=0.0,
                 standardization=False, maxIter=500)
        return LogisticRegression(**{**p, **own.get("LogisticRegression", {})})

    return [
        Candidate("GBT", gbt),
        Candidate("RandomForest", forest, margin="probability"),
        Candidate("LogisticRegression", logistic, scaled=True),
    ]


def regressors(seed: int = 42, overrides: dict[str, dict] | None = None) -> list[Candidate]:
    own = overrides or {}

    def gbt(ctx: dict) -> GBTRegressor:
        p = dict(maxIter=100, maxDepth=3, stepSize=0.05, subsamplingRate=0.8, seed=seed)
        return GBTRegressor(**{**p, **own.get("GBT", {})})

    def forest(ctx: dict) -> RandomForestRegressor:
        p = dict(numTrees=100, maxDepth=5, seed=seed)
        return RandomForestRegressor(**{**p, **own.get("RandomForest", {})})

    def ridge(ctx: dict) -> LinearRegression:
        # The solver scales the label, hence the factor std(y) in the penalty.
        alpha = own.get("Ridge", {}).get("alpha", 1.0)
        reg = alpha * (ctx["y_std"] or 1.0) / max(ctx["n"], 1)
        return LinearRegression(
            regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal"
        )

    return [
        Candidate("GBT", gbt),
        Candidate("RandomForest", forest),
        Candidate("Ridge", ridge, scaled=True),
    ]


def _label(target: str, binary: bool):
    y = cell(target).cast("double")
    if not binary:
        return y.alias(LABEL)
    # Two declared classes, so that a one-class training part keeps its shape.
    meta = {"ml_attr": {"type": "nominal", "vals": ["0.0", "1.0"], "name": LABEL}}
    return y.alias(LABEL, metadata=meta)


def platt_rows(scored: DataFrame, margin: str, positives: int, negatives: int) -> DataFrame:
    """Each row twice, as positive and negative, weighted by its smoothed target."""
    t = F.when(F.col(LABEL) == 1, F.lit((positives + 1.0) / (positives + 2.0))).otherwise(
        F.lit(1.0 / (negatives + 2.0))
    )
    sides = F.array(
        F.struct(F.lit(1.0).alias("_t"), t.alias("_w")),
        F.struct(F.lit(0.0).alias("_t"), (1.0 - t).alias("_w")),
    )
    return scored.select(margin, F.inline(sides))


def without_summary(spark: SparkSession, model: Any) -> Any:
    """The model as it comes back from storage: without the summary of its training.

    Some summaries hold the session, which cannot be sent to tasks once it has observed a
    plan, and a model that scores is sent with all it holds.
    """
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_path(spark, "model")
    model.write().save(path)
    return type(model).load(path)


def fit_calibrated(
    train: DataFrame, candidate: Candidate, seed: int = 42
) -> tuple[list[Any], list[str]]:
    """Stages of the calibrated members and their probability columns.

    ``train`` has FEATURES, the label and ``_inner``.  Each member is fitted without
    one inner fold and its margins are mapped to probabilities on that fold; there are
    always INNER_FOLDS members, and a class that does not reach all inner folds is an error.
    """
    counts = {
        (r["_inner"], int(r[LABEL])): r["n"]
        for r in train.groupBy("_inner", LABEL).agg(F.count("*").alias("n")).collect()
    }
    # Looked at before any fit: without a class the margins are infinite.
    if not all(counts.get((i, y)) for i in range(INNER_FOLDS) for y in (0, 1)):
        raise ValueError(f"calibration needs {INNER_FOLDS} groups of each class on every training side")
    stages, outs = [], []
    for i in range(INNER_FOLDS):
        pos = sum(n for (f, y), n in counts.items() if f != i and y == 1)
        neg = sum(n for (f, y), n in counts.items() if f != i and y == 0)
        held = counts.get((i, 1), 0), counts.get((i, 0), 0)
        raw, prob, slot, out = f"_raw{i}", f"_prob{i}", f"_m{i}", f"_cal{i}"
        est = candidate.make({"n": pos + neg})
        est = est.setFeaturesCol(FEATURES).setLabelCol(LABEL).setPredictionCol(f"_pred{i}")
        est = est.setRawPredictionCol(raw).setProbabilityCol(prob)
        base = without_summary(train.sparkSession, est.fit(train.where(F.col("_inner") != i)))
        source = raw if candidate.margin == "raw" else prob
        cut = VectorSlicer(inputCol=source, outputCol=slot, indices=[1])
        scored = cut.transform(base.transform(train.where(F.col("_inner") == i)))
        platt = LogisticRegression(
            featuresCol=slot, labelCol="_t", weightCol="_w", predictionCol=f"_pp{i}",
            rawPredictionCol=f"_pr{i}", probabilityCol=out, regParam=0.0, maxIter=100, tol=1e-9,
            standardization=True,
        ).fit(platt_rows(scored, slot, *held))
        stages += [base, cut, without_summary(train.sparkSession, platt)]
        outs.append(out)
    return stages, outs


def calibration_report(
    df: DataFrame, columns: list[str], target: str, candidate: Candidate, key: str = KEY, seed: int = 42
) -> DataFrame:
    """One row per member of a linear candidate fitted on all rows of one feature.

    inner, rows per class it learned from and was calibrated on, weight and bias of its
    margin, slope and intercept of its calibration.
    """
    known = df.where(cell(target).isNotNull())
    one_fold = known.where(cell(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).withColumn("fold", F.lit(0))
    classes = known.groupBy(key).agg(F.max(cell(target).cast("int")).alias("_class"))
    tagged = durable(
        with_folds(known.select(key, target, *[cell(c) for c in columns]), inner_ranks(one_fold, classes, key, seed), key)
    )
    stats = fit_stats(tagged.select(*[cell(c) for c in columns]), columns)[WHOLE]
    prep = build_prep(tagged.select(*[cell(c) for c in columns]), stats, candidate.scaled, FEATURES)
    inner = inner_fold(class_groups(tagged, key), -1, INNER_FOLDS)
    train = durable(prep.transform(tagged).select(_label(target, True), FEATURES, inner.alias("_inner")))
    stages, _ = fit_calibrated(train, candidate, seed)
    rows = []
    for i in range(INNER_FOLDS):
        base, _, platt = stages[3 * i : 3 * i + 3]
        rows.append((i, float(base.coefficients[0]), float(base.intercept), float(platt.coefficients[0]), float(platt.intercept)))
    members = df.sparkSession.createDataFrame(rows, "inner int, weight double, bias double, slope double, intercept double")
    y = F.col(LABEL) == 1
    held = train.groupBy(F.col("_inner").alias("inner")).agg(F.count_if(y).alias("held_pos"), F.count_if(~y).alias("held_neg"))
    everyone = W.partitionBy()  # one row per member
    return held.join(F.broadcast(members), "inner").select(
        "inner",
        (F.sum("held_pos").over(everyone) - F.col("held_pos")).alias("train_pos"),
        (F.sum("held_neg").over(everyone) - F.col("held_neg")).alias("train_neg"),
        "held_pos", "held_neg", "weight", "bias", "slope", "intercept",
    )


def calibrated_columns(model: PipelineModel) -> list[str]:
    """Member probability columns of a stored fold model."""
    return [
        s.getProbabilityCol()
        for s in model.stages
        if s.hasParam("probabilityCol") and s.getProbabilityCol().startswith("_cal")
    ]


def add_probability(df: DataFrame, model: PipelineModel, out: str = "prob") -> DataFrame:
    """Mean calibrated probability of one fold model; other model columns are dropped."""
    scored = model.transform(df)
    parts = [vector_to_array(F.col(c))[1] for c in calibrated_columns(model)]
    mean = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
    return scored.select(*[cell(c) for c in df.columns], mean.alias(out))


def add_prediction(df: DataFrame, model: PipelineModel, out: str = "prediction") -> DataFrame:
    scored = model.transform(df)
    return scored.select(*[cell(c) for c in df.columns], F.col("_pred").alias(out))


def score_probability(df: DataFrame, folds: list[PipelineModel], out: str = "prob") -> DataFrame:
    """Mean over the fold models' probabilities: narrow, no shuffle."""
    rows = df
    for k, m in enumerate(folds):
        rows = add_probability(rows, m, f"_f{k}")
    names = [f"_f{k}" for k in range(len(folds))]
    return rows.withColumn(out, fold_mean(names)).drop(*names)


def score_ensemble(
    df: DataFrame, members: dict[str, list[PipelineModel]], out: str = "prob"
) -> DataFrame:
    rows = df
    for i, folds in enumerate(members.values()):
        rows = score_probability(rows, folds, f"_e{i}")
    names = [f"_e{i}" for i in range(len(members))]
    return rows.withColumn(out, fold_mean(names)).drop(*names)


def score_regression(
    df: DataFrame,
    folds: list[PipelineModel],
    bounds: tuple[float | None, float | None],
    out: str = "prediction",
) -> DataFrame:
    """Fold mean, clipped per fold and as a mean."""
    rows = df
    for k, m in enumerate(folds):
        rows = add_prediction(rows, m, f"_f{k}")
    names = [f"_f{k}" for k in range(len(folds))]
    return rows.withColumn(out, fold_mean(names, bounds)).drop(*names)


@dataclass
class Trained:
    """Result of one benchmark: long out-of-fold rows and the fold models per candidate."""

    oof: DataFrame
    models: dict[str, list[PipelineModel]]
    stats: dict[int, PrepStats]


def _run(jobs: list[Callable[[], Any]], parallelism: int) -> list[Any]:
    if parallelism <= 1:
        return [j() for j in jobs]
    spark = SparkSession.getActiveSession()
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(j)) for j in jobs]]


def _tagged(
    df: DataFrame, columns: list[str], target: str, k: int, key: str, inner_seed: int | None = None
) -> tuple[DataFrame, dict[int, PrepStats]]:
    """Rows with a known target and their folds, and the statistics of every training side.

    With ``inner_seed`` the rows also carry what the inner folds are dealt from.
    """
    known = df.where(cell(target).isNotNull())
    folds = group_folds(known, k, key)
    if inner_seed is not None:
        classes = known.groupBy(key).agg(F.max(cell(target).cast("int")).alias("_class"))
        folds = inner_ranks(folds, classes, key, inner_seed)
    # Read many times by the fits: written once, so no executor loss repeats the features.
    tagged = durable(
        with_folds(known.select(key, target, *[cell(c) for c in columns]), folds, key)
    )
    assert_folds_disjoint(tagged, key)
    stats = fit_stats(tagged, columns, list(range(k)))
    if wide := stats[0].wide:
        # Rows to be scored later take their slots from the same dictionary, by ``with_slots``.
        tagged = durable(with_slots(tagged, level_dictionary(tagged, list(wide)), wide))
    return tagged, stats


def class_groups(tagged: DataFrame, key: str = KEY) -> dict[tuple[int, int], int]:
    """Groups per (fold, class): two numbers per fold."""
    counts = tagged.groupBy("fold", "_class").agg(F.max("_dealt").alias("n")).collect()
    return {(r["fold"], r["_class"]): r["n"] for r in counts}


def train_classification(
    df: DataFrame,
    columns: list[str],
    target: str,
    candidates: list[Candidate],
    k: int = 5,
    key: str = KEY,
    seed: int = 42,
    parallelism: int = 4,
) -> Trained:
    """Group-disjoint folds; every candidate calibrated and scored out of fold."""
    tagged, stats = _tagged(df, columns, target, k, key, seed)
    dealt = class_groups(tagged, key)
    schema_only = tagged.select(*[cell(c) for c in [*columns, *map(slot_column, stats[0].wide)]])
    models: dict[str, list[PipelineModel]] = {}
    parts: list[DataFrame] = []

    def one(c: Candidate, fold: int) -> tuple[PipelineModel, DataFrame]:
        prep = build_prep(schema_only, stats[fold], c.scaled, FEATURES)
        side = tagged.where(F.col("fold") != fold)
        train = prep.transform(side).select(
            _label(target, True), FEATURES, inner_fold(dealt, fold, INNER_FOLDS).alias("_inner")
        ).persist()
        try:
            stages, _ = fit_calibrated(train, c, seed)
        finally:
            train.unpersist()
        model = PipelineModel([*prep.stages, *stages])
        held = add_probability(tagged.where(F.col("fold") == fold), model)
        rows = held.select(
            F.lit(c.name).alias("model"), key, cell(target).cast("int").alias("y_true"), "prob",
            "fold",
        )
        return model, rows

    jobs = [(c, f) for c in candidates for f in range(k)]
    done = _run([lambda c=c, f=f: one(c, f) for c, f in jobs], parallelism)
    for (c, _), (model, rows) in zip(jobs, done):
        models.setdefault(c.name, []).append(model)
        parts.append(rows)
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return Trained(durable(oof), models, stats)


def train_regression(
    df: DataFrame,
    columns: list[str],
    target: str,
    candidates: list[Candidate],
    bounds: tuple[float | None, float | None],
    condition: str | None = "injured_in_risk_window",
    k: int = 5,
    key: str = KEY,
    seed: int = 42,
    parallelism: int = 4,
) -> Trained | None:
    """Regressors on positives with a known target; None where there are none."""
    rows = df.where(cell(condition) == 1) if condition else df
    rows = rows.where(cell(target).isNotNull())
    if not rows.limit(1).count():
        return None
    tagged, stats = _tagged(rows, columns, target, k, key)
    sizes = {
        r["fold"]: r
        for r in tagged.groupBy("fold")
        .agg(F.count("*").alias("n"), F.sum(cell(target)).alias("s"),
             F.sum(cell(target) * cell(target)).alias("q"))
        .collect()
    }
    schema_only = tagged.select(*[cell(c) for c in [*columns, *map(slot_column, stats[0].wide)]])
    models: dict[str, list[PipelineModel]] = {}
    parts: list[DataFrame] = []

    def one(c: Candidate, fold: int) -> tuple[PipelineModel, DataFrame]:
        rest = [r for f, r in sizes.items() if f != fold]
        n = sum(r["n"] for r in rest)
        mean = sum(r["s"] for r in rest) / max(n, 1)
        var = max(sum(r["q"] for r in rest) / max(n, 1) - mean * mean, 0.0)
        prep = build_prep(schema_only, stats[fold], c.scaled, FEATURES)
        side = tagged.where(F.col("fold") != fold)
        train = prep.transform(side).select(_label(target, False), FEATURES).persist()
        try:
            est = c.make({"n": n, "y_std": var**0.5})
            est = est.setFeaturesCol(FEATURES).setLabelCol(LABEL).setPredictionCol("_pred")
            fitted = est.fit(train)
        finally:
            train.unpersist()
        model = PipelineModel([*prep.stages, fitted])
        held = add_prediction(tagged.where(F.col("fold") == fold), model)
        out = held.select(
            F.lit(c.name).alias("model"), key, cell(target).alias("actual"),
            clip(F.col("prediction"), *bounds).alias("predicted"), "fold",
        )
        return model, out

    jobs = [(c, f) for c in candidates for f in range(k)]
    done = _run([lambda c=c, f=f: one(c, f) for c, f in jobs], parallelism)
    for (c, _), (model, out) in zip(jobs, done):
        models.setdefault(c.name, []).append(model)
        parts.append(out)
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return Trained(durable(oof), models, stats)


def _weights_of(stage: Any) -> list[float] | None:
    if hasattr(stage, "featureImportances"):
        return [float(v) for v in stage.featureImportances.toArray()]
    if hasattr(stage, "coefficients"):
        return [abs(float(v)) for v in stage.coefficients.toArray()]
    return None


def feature_importance(
    spark: SparkSession,
    folds: list[PipelineModel],
    stats: dict[int, PrepStats],
    first_member_only: bool = False,
) -> DataFrame:
    """(feature, importance): mean over members and folds, largest first.

    Importances are a handful of model numbers per fold, already on the driver.
    """
    rows = []
    for fold, model in enumerate(folds):
        names = feature_names(stats[fold])
        members = [s for s in model.stages if s.hasParam("featuresCol")
                   and s.getFeaturesCol() == FEATURES]
        for m, stage in enumerate(members[:1] if first_member_only else members):
            values = _weights_of(stage)
            if values is not None:
                rows += [(n, fold, m, v) for n, v in zip(names, values)]
    schema = "feature string, fold int, member int, importance double"
    return (
        spark.createDataFrame(rows, schema)
        .groupBy("feature", "fold").agg(F.avg("importance").alias("importance"))
        .groupBy("feature").agg(F.avg("importance").alias("importance"))
        .orderBy(F.desc("importance"), F.asc("feature"))
    )


def global_linear_weights(model: PipelineModel, stats: PrepStats) -> dict[str, float]:
    """Coefficients by feature name of the first linear member."""
    for s in model.stages:
        if s.hasParam("featuresCol") and s.getFeaturesCol() == FEATURES and hasattr(
            s, "coefficients"
        ):
            return dict(zip(feature_names(stats), [float(v) for v in s.coefficients.toArray()]))
    raise ValueError("the model has no linear member")
