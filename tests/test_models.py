"""Preprocessing, closed-form fits, scoring, attribution and the whole job."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.operators import explain as X
from tidemark.operators import models as M
from tidemark.operators import prep as P
from tidemark.operators import score as SC
from tidemark.plans import pipeline as PL
from tidemark.sources import model_store, sinks


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(120):
        a, b = float(rng.normal()), float(rng.normal())
        p = 1 / (1 + math.exp(-(1.5 * a - b)))
        y = int(rng.random() < p)
        rows.append(
            (i, a if i % 9 else None, b, "uvw"[i % 3] if i % 7 else None, y,
             float(1 + i % 30) if y else None, float(5 + 2 * b) if y else None)
        )
    return spark.createDataFrame(
        rows,
        "athlete_id long, a double, b double, team string, injured_in_risk_window int, "
        "onset_day_offset double, recovery_duration double",
    ).cache()


COLS = ["a", "b", "team"]


def test_prep_numbers_and_levels(spark):
    df = spark.createDataFrame(
        [(1.0, "x"), (2.0, None), (None, "y"), (10.0, "x")], "n double, c string"
    )
    s = P.fit_stats(df, ["n", "c"])[P.WHOLE]
    filled = np.array([1.0, 2.0, 2.0, 10.0])
    assert s.medians == {"n": 2.0}
    assert s.means["n"] == pytest.approx(filled.mean()) and s.stds["n"] == pytest.approx(filled.std())
    assert s.levels == {"c": ["nan", "x", "y"]}
    assert P.feature_names(s) == ["n", "c_nan", "c_x", "c_y"]
    model = P.build_prep(df, s, scale=True)
    new = spark.createDataFrame([(None, "zzz"), (10.0, "y"), (1.0, None)], df.schema)
    got = [r[0] for r in model.transform(new).select(vector_to_array("features")).collect()]
    z = (filled - filled.mean()) / filled.std()
    assert got[0] == pytest.approx([z[1], 0, 0, 0])  # unseen level: all zeros
    assert got[1] == pytest.approx([z[3], 0, 0, 1])
    assert got[2] == pytest.approx([z[0], 1, 0, 0])


def test_stats_per_training_side(spark):
    df = spark.createDataFrame(
        [(0, 1.0, "p"), (0, 3.0, "p"), (1, 10.0, "q"), (2, 20.0, "q")], "fold int, n double, c string"
    )
    s = P.fit_stats(df, ["n", "c"], [0, 1, 2])
    assert [s[k].medians["n"] for k in (0, 1, 2)] == [15.0, 3.0, 3.0]
    assert [s[k].levels["c"] for k in (0, 1, 2)] == [["q"], ["p", "q"], ["p", "q"]]


def test_logistic_matches_its_objective(spark, toy):
    """Newton's method on the penalised objective gives the same weights."""
    s = P.fit_stats(toy, ["a", "b"])[P.WHOLE]
    rows = P.build_prep(toy, s, True).transform(toy)
    y = toy.select("injured_in_risk_window").toPandas().to_numpy().ravel()
    n = len(y)
    est = [c for c in M.classifiers() if c.name == "LogisticRegression"][0].make({"n": n})
    fit = est.setFeaturesCol("features").setLabelCol("injured_in_risk_window").setTol(1e-10).fit(rows)
    x = np.array([r[0] for r in rows.select(vector_to_array("features")).collect()])
    x1 = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(3)
    pen = np.diag([1.0, 1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        g = 0.5 * x1.T @ (p - y) + pen @ w
        h = 0.5 * x1.T @ (x1 * (p * (1 - p))[:, None]) + pen
        w -= np.linalg.solve(h, g)
    assert list(fit.coefficients) + [fit.intercept] == pytest.approx(list(w), abs=1e-4)


def test_calibration_targets(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, -1.0)], "_y double, m double")
    rows = {(r.m, r._t): r._w for r in M.platt_rows(df, "m", 3, 5).collect()}
    assert rows[(2.0, 1.0)] == pytest.approx(4 / 5) and rows[(2.0, 0.0)] == pytest.approx(1 / 5)
    assert rows[(-1.0, 1.0)] == pytest.approx(1 / 7)


@pytest.fixture(scope="module")
def trained(toy):
    zoo = [c for c in M.classifiers(1, {"RandomForest": {"numTrees": 4}}) if c.name != "GBT"]
    return M.train_classification(toy, COLS, "injured_in_risk_window", zoo, k=2, parallelism=2)


def test_oof_covers_every_entity_once_per_model(trained, toy):
    got = trained.oof.groupBy("model", "athlete_id").count().collect()
    assert len(got) == 2 * toy.count() and {r["count"] for r in got} == {1}
    r = trained.oof.agg(F.min("prob"), F.max("prob")).first()
    assert 0 <= r[0] < r[1] <= 1
    pairs = trained.oof.where("model = 'LogisticRegression'").select("y_true", "prob").toPandas()
    pos, neg = pairs[pairs.y_true == 1].prob.mean(), pairs[pairs.y_true == 0].prob.mean()
    assert pos > neg + 0.1  # the signal is found out of fold


def test_importance_names(spark, trained):
    imp = M.feature_importance(spark, trained.models["RandomForest"], trained.stats).collect()
    assert {r.feature for r in imp} == {"a", "b", "team_nan", "team_u", "team_v", "team_w"}
    assert [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True)
    lin = M.feature_importance(spark, trained.models["LogisticRegression"], trained.stats, True)
    assert {r.feature for r in lin.limit(2).collect()} == {"a", "b"}


def test_store_roundtrip_scores_the_same(spark, trained, toy, tmp_path):
    root = str(tmp_path / "m")
    folds = trained.models["LogisticRegression"]
    model_store.save_folds(root, "classification", "LogisticRegression", folds)
    assert model_store.stored_models(spark, root, "classification") == ["LogisticRegression"]
    back = model_store.load_folds(spark, root, "classification", "LogisticRegression")
    a = M.score_probability(toy, folds).select("athlete_id", "prob").collect()
    b = M.score_probability(toy, back).select("athlete_id", "prob").collect()
    assert dict(map(tuple, a)) == pytest.approx(dict(map(tuple, b)))
    with pytest.raises(FileNotFoundError):
        model_store.load_folds(spark, root, "classification", "none")


def test_shapley_adds_up(spark, toy):
    bg = {"a": 0.0, "b": 0.5}
    coef = {"a": 2.0, "b": -1.0}

    def score(df):
        return df.withColumn("prob", 2.0 * F.col("a") - F.col("b") + F.col("a") * F.col("b"))

    part = toy.select("athlete_id", "a", "b").where("athlete_id < 12")
    got = X.sampled_shapley(part, ["a", "b"], bg, score, samples=8)
    sums = {r.athlete_id: r.s for r in got.groupBy("athlete_id").agg(F.sum("contribution").alias("s")).collect()}
    for r in part.collect():
        a, b = (bg["a"] if r.a is None else r.a), r.b
        assert sums[r.athlete_id] == pytest.approx((2 * a - b + a * b) - (0 - 0.5), abs=1e-9)
    lin = X.linear_attribution(part, coef, bg)
    exact = {(r.athlete_id, r.feature): r.contribution for r in lin.collect()}
    one = X.sampled_shapley(
        part, ["a", "b"], bg,
        lambda d: d.withColumn("prob", 2.0 * F.col("a") - F.col("b")), samples=3,
    )
    for r in one.collect():
        assert r.contribution == pytest.approx(exact[(r.athlete_id, r.feature)], abs=1e-9)


def test_shapley_of_texts_and_repeated_sets(spark, toy):
    """Texts enter as they are, a set of features is scored once, and the error is that of the pairs."""
    seen = []

    def score(df):
        seen.append(df)
        bonus = F.when(F.col("team") == "x", 1.0).when(F.col("team").isNull(), 5.0).otherwise(0.0)
        return df.withColumn("prob", F.col("a") * (1 + bonus) + F.col("b"))

    part = spark.createDataFrame([(1, 2.0, 1.0, "x"), (2, None, 3.0, None), (3, 1.0, 0.0, "y")], "athlete_id long, a double, b double, team string")
    got = X.sampled_shapley(part, ["a", "b", "team"], {"a": 1.0, "b": 0.0, "team": "y"}, score, samples=16).collect()
    sums = {}
    for r in got:
        sums[r.athlete_id] = sums.get(r.athlete_id, 0) + r.contribution
        assert r.std_error >= 0
    assert sums == pytest.approx({1: 2 * 2 + 1 - 1, 2: 1 * 6 + 3 - 1, 3: 0.0})
    assert {r.std_error for r in got if r.feature == "b"} == {0.0}
    assert seen[0].count() <= 3 * 2**3


def test_top_and_global_attributions(spark):
    rows = [(1, "f", -3.0), (1, "g", 1.0), (1, "h", 2.0), (2, "f", 0.5)]
    df = spark.createDataFrame(rows, "athlete_id long, feature string, contribution double")
    top = [tuple(r) for r in X.top_attributions(df, 2).where("athlete_id = 1").collect()]
    assert top == [(1, 1, "f", -3.0), (1, 2, "h", 2.0)]
    assert X.global_attribution(df, 1).first().feature == "h"


BOARD = "model string, task string, score double, best_threshold double"


def test_model_choice(spark):
    b = spark.createDataFrame(
        [("A", "classification", 0.5, 0.3), ("B", "classification", 0.6, 0.4),
         ("Top3_Ensemble", "classification", 0.6, 0.35), ("A", "onset", 3.0, None),
         ("B", "onset", 2.0, None)],
        BOARD,
    )
    assert SC.choose_classifier(b, ["A", "B"], ["A", "B"]) == ("Top3_Ensemble", 0.35)
    assert SC.choose_classifier(b, ["B"], ["A", "B"]) == ("B", 0.4)
    low = b.withColumn("score", F.when(F.col("model") == "Top3_Ensemble", 0.1).otherwise(F.col("score")))
    assert SC.choose_classifier(low, ["A", "B"], ["A", "B"]) == ("B", 0.4)
    assert SC.choose_classifier(b, ["Z"], []) == ("Z", 0.5)
    with pytest.raises(FileNotFoundError):
        SC.choose_classifier(b, [], [])
    assert SC.choose_regressor(b, "onset", ["A", "B"]) == "B"
    assert SC.choose_regressor(b, "onset", ["A", "B"], "A") == "A"
    assert SC.choose_regressor(b, "onset", ["A"], "none") == "A"


def test_submission_clip_round_and_mask(spark):
    df = spark.createDataFrame(
        [(1, 0.5, -1.0, -2.0), (2, 0.49, 2.5, 2.5), (3, 0.9, 99.0, 61.5)],
        "athlete_id long, prob double, onset double, recovery double",
    )
    got = [tuple(r) for r in SC.submission(df, 0.5).orderBy("athlete_id").collect()]
    assert got == [(1, 1, 1, 0), (2, 0, 2, 2), (3, 1, 30, 62)]
    masked = SC.submission(df, 0.5, mask_negative=True).where("athlete_id = 2").first()
    assert masked.onset_day_offset is None
    assert SC.predicted_rate(SC.submission(df, 0.5)).first().positives == 2
    assert SC.checked_cutoff(None, None) == 0.43 and SC.checked_cutoff(0.2, 0.3) == 0.2
    with pytest.raises(ValueError):
        SC.checked_cutoff(0.99, None)
    rank = [(r.athlete_id, r["rank"]) for r in SC.risk_ranking(df, 0.5).orderBy("rank").collect()]
    assert rank == [(3, 1), (1, 2), (2, 3)]


def test_what_if_changes_only_named_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "athlete_id long, a double, b double")

    def score(d):
        return d.withColumn("prob", F.col("a") + F.coalesce("b", F.lit(0.0)))

    got = {
        (r.athlete_id, r.scenario): (r.original, r.simulated, r.delta)
        for r in SC.what_if(df, {"s": {"a": 5.0}, "t": {"b": 1.0}}, score).collect()
    }
    assert got == {
        (1, "s"): (3.0, 7.0, 4.0), (1, "t"): (3.0, 2.0, -1.0),
        (2, "s"): (3.0, 5.0, 2.0), (2, "t"): (3.0, 4.0, 1.0),
    }


def test_benchmark_store_and_submit(spark, toy, tmp_path):
    root = str(tmp_path / "run")
    s = PL.Settings(
        k=2, overrides={"RandomForest": {"numTrees": 3, "maxDepth": 3}},
        classifiers=["RandomForest", "LogisticRegression"], regressors=["Ridge"],
    )
    run = PL.benchmark(toy, s)
    board = {(r.task, r.model) for r in run.board.collect()}
    assert board == {
        ("classification", "RandomForest"), ("classification", "LogisticRegression"),
        ("classification", "Top3_Ensemble"), ("onset", "Ridge"), ("recovery", "Ridge"),
    }
    PL.store(run, root)
    back = sinks.read_benchmark(spark, f"{root}/benchmark_results")
    curve = back.where("model = 'Top3_Ensemble'").first().threshold_curve
    assert len(curve.thresholds) == 91 and curve.thresholds[0] == 0.05
    sub = PL.generate_submission(toy.drop("injured_in_risk_window"), root, f"{root}/sub").collect()
    assert len(sub) == toy.count()
    assert all(1 <= r.onset_day_offset <= 30 and r.recovery_duration >= 0 for r in sub)
    rec = run.trained["recovery"].oof.select("actual", "predicted").toPandas()
    assert (rec.actual - rec.predicted).abs().mean() < 1.0  # recovery is linear in b


def test_whole_job_from_csv_files(spark, tmp_path):
    """Raw CSV folder in, submission for a separate test folder out."""
    import datetime as dt

    rng = np.random.default_rng(3)
    start = dt.date(2026, 1, 5)
    raw = {"train": range(1, 41), "test": range(101, 106)}
    for name, ids in raw.items():
        d = tmp_path / name
        d.mkdir()
        days = [start + dt.timedelta(days=i) for i in range(30)]
        with open(d / "dailyActivity_merged.csv", "w") as f:
            f.write("Id,ActivityDate,TotalSteps,Calories\n")
            f.writelines(f"{i},{x},{1000 + 50 * i + rng.integers(99)},{2000}\n" for i in ids for x in days)
        with open(d / "athlete_metadata.csv", "w") as f:
            f.write("athlete_id,sport,weight_kg\n")
            f.writelines(f"{i},{'ab'[i % 2]},{70 + i % 5}\n" for i in ids)
    with open(tmp_path / "train" / "train_labels.csv", "w") as f:
        f.write("athlete_id,injured,onset_day,recovery_days,obs_end\n")
        f.writelines(
            f"{i},{int(i > 20)},{i % 30 if i > 20 else ''},{i / 4 if i > 20 else ''},2026-02-03\n"
            for i in raw["train"]
        )
    s = PL.Settings(
        k=2, overrides={"RandomForest": {"numTrees": 3}}, classifiers=["LogisticRegression"],
        regressors=["Ridge"],
    )
    out = PL.run_pipeline(
        spark, str(tmp_path / "train"), str(tmp_path / "out"), test=str(tmp_path / "test"), settings=s
    )
    rows = sorted(out.collect())
    assert [r.athlete_id for r in rows] == list(raw["test"])
    assert all(r.injured_in_risk_window == 1 for r in rows)  # far more steps than any negative
    wide = spark.read.parquet(str(tmp_path / "out" / "features"))
    assert wide.count() == 40 and len(wide.columns) == 73
    assert {r[0] for r in wide.select("obs_window_end").distinct().collect()} == {dt.date(2026, 2, 3)}


def test_models_score_after_the_session_observed_a_plan(spark, toy):
    """A training summary holds the session, which no task can be sent after an observation."""
    seen = Observation()
    toy.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] == 120
    prep = P.build_prep(toy, P.fit_stats(toy, COLS)[P.WHOLE], True)
    rows = prep.transform(toy).withColumn(M.LABEL, F.col("injured_in_risk_window").cast("double"))
    small = M.classifiers(overrides={"RandomForest": {"numTrees": 3}})
    for c in (c for c in small if c.name != "GBT"):
        fitted = c.make({"n": 120}).setLabelCol(M.LABEL).fit(rows)
        kept = M.without_summary(spark, fitted)
        assert kept.uid == fitted.uid and not kept.hasSummary
        assert kept.transform(rows).select("probability").count() == 120
        assert all(0 <= r[0] <= 1 for r in kept.transform(rows).select(vector_to_array("probability")[1]).collect())


def test_calibrated_members_score_after_the_session_observed_a_plan(spark, toy):
    seen = Observation()
    toy.observe(seen, F.count("*").alias("n")).collect()
    small = M.classifiers(overrides={"LogisticRegression": {"maxIter": 10}})[-1:]
    out = M.train_classification(toy, COLS, "injured_in_risk_window", small, k=2)
    assert out.oof.where("prob between 0 and 1").count() == 120
    assert not any(getattr(s, "hasSummary", False) for m in out.models["LogisticRegression"] for s in m.stages)


def test_shapley_deals_entities_once(spark, toy, capsys):
    """Steps, sets and scores of an entity stay where the entity is: nothing but entities is shuffled."""
    part = toy.select("athlete_id", "a", "b", "team")
    got = X.sampled_shapley(part, ["a", "b", "team"], {"a": 0.0}, lambda d: d.withColumn("prob", F.col("b") + F.length("team")), samples=8)
    capsys.readouterr()
    got.explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_shapley_keeps_wide_projections_out_of_whole_stage_code(spark, toy):
    """One method for all features is too long for the JVM to compile; the join passes features as one column."""
    part = toy.select("athlete_id", "a", "b", "team")
    got = X.sampled_shapley(part, ["a", "b", "team"], {"a": 0.0}, lambda d: d.withColumn("prob", F.col("b") + F.length("team")), samples=8)
    assert got.count() == 3 * part.count()
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    wide = [x for x in plan.split("\n") if "Project [" in x and ("_bits0" in x or "_own" in x)]
    assert wide and not any("*(" in x for x in wide if "CASE WHEN" in x)


def test_shapley_of_more_features_than_a_word_has_bits(spark):
    names = [f"x{i}" for i in range(2 * X.WORD + 5)]
    df = spark.createDataFrame([(1, *map(float, range(len(names))))], "athlete_id long, " + ", ".join(f"{c} double" for c in names))
    weights = [1.0 + i % 7 for i in range(len(names))]
    score = lambda d: d.withColumn("prob", sum((F.col(c) * w for c, w in zip(names, weights)), F.lit(0.0)))
    got = X.sampled_shapley(df, names, dict.fromkeys(names, 0.0), score, samples=2).collect()
    want = {c: i * w for i, (c, w) in enumerate(zip(names, weights))}
    assert {r.feature: r.contribution for r in got} == pytest.approx(want, abs=1e-6)


def test_calibration_without_a_class_is_refused_before_any_fit(spark):
    """One positive for three inner folds: the first member would learn from negatives alone."""
    rows = [(i, float(i % 4), int(i == 2)) for i in range(15)]
    df = spark.createDataFrame(rows, "athlete_id long, a double, injured_in_risk_window int")
    with pytest.raises(ValueError, match="3 groups of each class"):
        M.calibration_report(df, ["a"], "injured_in_risk_window", M.classifiers()[-1])
