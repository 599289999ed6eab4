"""End-to-end jobs: build features, train and store, score and submit."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import cell, meets
from tidemark.operators import evaluate as E
from tidemark.operators import models as M
from tidemark.operators import score as SC
from tidemark.operators.features import anchor_of, combine_features, feature_columns
from tidemark.schema import KEY
from tidemark.session import durable
from tidemark.sources import sinks
from tidemark.sources.files import exists
from tidemark.sources.model_store import load_folds, save_folds, stored_models
from tidemark.sources.readers import load_raw

REGRESSION_TASKS = {
    "onset": ("onset_day_offset", SC.ONSET_BOUNDS),
    "recovery": ("recovery_duration", SC.RECOVERY_BOUNDS),
}
LABEL = "injured_in_risk_window"


@dataclass
class Settings:
    """What a run may vary.  ``overrides`` holds estimator parameters per candidate."""

    k: int = 5
    seed: int = 42
    parallelism: int = 4
    overrides: dict[str, dict] = field(default_factory=dict)
    classifiers: list[str] | None = None
    regressors: list[str] | None = None

    def pick(self, all_: list[M.Candidate], names: list[str] | None) -> list[M.Candidate]:
        return [c for c in all_ if names is None or c.name in names]


@dataclass
class Benchmark:
    board: DataFrame
    curves: DataFrame
    scores: DataFrame
    importances: DataFrame
    top: list[str]
    trained: dict[str, M.Trained]


def benchmark(features: DataFrame, settings: Settings | None = None) -> Benchmark:
    """Tasks A, B and C: out-of-fold scores, tuned cutoffs, ensemble, leaderboard, importances."""
    s = settings or Settings()
    columns = feature_columns(features)
    zoo = s.pick(M.classifiers(s.seed, s.overrides), s.classifiers)
    order = [c.name for c in zoo]
    cls = M.train_classification(
        features, columns, LABEL, zoo, s.k, seed=s.seed, parallelism=s.parallelism
    )
    single = cls.oof.select("model", KEY, "y_true", "prob")
    single_best = durable(E.best_threshold(E.threshold_curve(single, by=["model"]), ["model"]))
    top = E.top_models(single_best, order)
    scores = single
    if len(top) >= 2:
        scores = durable(single.unionByName(E.ensemble_mean(single, top)))
    curves = durable(E.threshold_curve(scores, by=["model"]))
    tuned = durable(E.best_threshold(curves, ["model"]))
    decided = E.apply_cutoffs(scores, tuned, ["model"])
    quality = E.classification_metrics(decided, F.col("predicted"), by=["model"])
    cls_board = tuned.join(quality.select("model", "accuracy", "roc_auc"), "model").select(
        "model",
        F.lit("classification").alias("task"),
        F.lit(LABEL).alias("target"),
        F.lit("F1").alias("metric"),
        F.col("best_f1").alias("score"),
        "best_threshold", "precision", "recall", "accuracy", "roc_auc",
        F.when(F.col("model") == SC.ENSEMBLE, F.array(*[F.lit(t) for t in top])).alias(
            "models_in_ensemble"
        ),
    )
    parts, trained = [cls_board], {"classification": cls}
    reg = s.pick(M.regressors(s.seed, s.overrides), s.regressors)
    for task, (target, bounds) in REGRESSION_TASKS.items():
        out = M.train_regression(
            features, columns, target, reg, bounds, LABEL, s.k, seed=s.seed,
            parallelism=s.parallelism,
        )
        if out is None:
            continue
        trained[task] = out
        m = E.regression_metrics(out.oof, "actual", "predicted", ["model"])
        parts.append(
            m.select(
                "model", F.lit(task).alias("task"), F.lit(target).alias("target"),
                F.lit("MAE").alias("metric"), F.col("mae").alias("score"), "rmse", "r2",
            )
        )
    board = durable(E.leaderboard(parts))
    importances = M.feature_importance(
        features.sparkSession, cls.models[top[0]], cls.stats
    )
    return Benchmark(board, curves, scores, importances, top, trained)


def store(run: Benchmark, root: str) -> None:
    """Leaderboard JSON, importance and out-of-fold CSVs, and every fold model."""
    sinks.write_json(sinks.benchmark_payload(run.board, run.curves), f"{root}/benchmark_results")
    sinks.write_csv(run.importances, f"{root}/feature_importance")
    names = [r["model"] for r in run.board.where(F.col("task") == "classification").collect()]
    sinks.write_csv(E.oof_wide(run.scores, sorted(names)), f"{root}/predictions")
    for task, t in run.trained.items():
        for name, folds in t.models.items():
            save_folds(f"{root}/models", task, name, folds)


def predict_probability(
    features: DataFrame, root: str, model: str | None = None
) -> tuple[DataFrame, float, str]:
    """Features with ``prob``, the cutoff to use and the model chosen."""
    spark = features.sparkSession
    where = f"{root}/models"
    board = sinks.read_benchmark(spark, f"{root}/benchmark_results")
    stored = stored_models(spark, where, "classification")
    row = board.where(F.col("model") == SC.ENSEMBLE).first()
    members = list(row["models_in_ensemble"] or []) if row else []
    name, cutoff = SC.choose_classifier(board, stored, members)
    if model is not None and model != name:
        name = model if model in stored or model == SC.ENSEMBLE else stored[0]
        own = board.where((F.col("task") == "classification") & (F.col("model") == name)).first()
        cutoff = own["best_threshold"] if own else 0.5
    if name == SC.ENSEMBLE:
        used = [m for m in members if m in stored] or stored[:3]
        folds = {m: load_folds(spark, where, "classification", m) for m in used}
        return M.score_ensemble(features, folds), cutoff, name
    return M.score_probability(features, load_folds(spark, where, "classification", name)), cutoff, name


def predict_regression(
    features: DataFrame, root: str, task: str, model: str | None = None, out: str | None = None
) -> DataFrame:
    spark = features.sparkSession
    where = f"{root}/models"
    board = sinks.read_benchmark(spark, f"{root}/benchmark_results")
    name = SC.choose_regressor(board, task, stored_models(spark, where, task), model)
    folds = load_folds(spark, where, task, name)
    return M.score_regression(features, folds, REGRESSION_TASKS[task][1], out or task)


def score_all(features: DataFrame, root: str) -> tuple[DataFrame, float]:
    """Features with ``prob``, ``onset`` and ``recovery``; tasks without models stay null."""
    rows, cutoff, _ = predict_probability(features, root)
    for task in REGRESSION_TASKS:
        if stored_models(features.sparkSession, f"{root}/models", task):
            rows = predict_regression(rows, root, task)
        else:
            rows = rows.withColumn(task, F.lit(None).cast("double"))
    return rows, cutoff


def generate_submission(features: DataFrame, root: str, path: str | None = None) -> DataFrame:
    rows, cutoff = score_all(features, root)
    out = SC.submission(rows, cutoff)
    if path:
        sinks.write_csv(out, path)
    return out


def decide(scored: DataFrame, cutoff: float) -> DataFrame:
    return scored.withColumn("predicted", meets(cell("prob"), cutoff))


def run_pipeline(
    spark: SparkSession,
    raw: dict[str, DataFrame] | str,
    root: str,
    anchor: str | dt.date | None = None,
    test: dict[str, DataFrame] | str | None = None,
    settings: Settings | None = None,
    **feature_options,
) -> DataFrame:
    """Features, training and a submission for the test tables (or the training entities)."""
    tables = load_raw(spark, raw) if isinstance(raw, str) else raw
    at = anchor_of(tables.get("train_labels"), anchor)  # one anchor for training and test
    path = f"{root}/features"
    sinks.write_features(combine_features(tables, at, **feature_options), path)
    features = spark.read.parquet(path)
    store(benchmark(features, settings), root)
    target = features
    if isinstance(test, str):
        test = load_raw(spark, test) if exists(spark, test) else None
    if test is not None:
        target = combine_features(test, at, include_labels=False, **feature_options)
    return generate_submission(target, root, f"{root}/submission")
