import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import meets
from tidemark.operators import evaluate as E
from tidemark.operators import folds as FO


def frame(spark, pairs):
    return spark.createDataFrame([(int(y), float(p)) for y, p in pairs], "y_true int, prob double")


def brute_curve(pairs, grid):
    out = []
    for t in grid:
        tp = sum(1 for y, p in pairs if y == 1 and p >= t)
        fp = sum(1 for y, p in pairs if y == 0 and p >= t)
        fn = sum(1 for y, p in pairs if y == 1 and p < t)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        out.append((t, f1, tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0))
    return out


GRID = [i / 100 for i in range(5, 96)]


def check_curve(spark, pairs, grid=None):
    got = E.threshold_curve(frame(spark, pairs), grid=grid).orderBy("threshold").collect()
    want = brute_curve(pairs, grid or GRID)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert tuple(g) == pytest.approx(w, abs=1e-12)
    best = E.best_threshold(E.threshold_curve(frame(spark, pairs), grid=grid)).first()
    top = (0.5, 0.0)
    for t, f1, _, _ in want:
        if f1 > top[1]:
            top = (t, f1)
    assert best.best_threshold == pytest.approx(round(top[0], 4))
    assert best.best_f1 == pytest.approx(round(top[1], 4), abs=1.1e-4)


# Scores on the grid itself are the hard case: 0.29 * 100 is below 29.
@given(st.lists(st.tuples(st.integers(0, 1), st.one_of(
    st.integers(0, 100).map(lambda i: i / 100), st.floats(0, 1))), min_size=1, max_size=40))
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_sweep_equals_brute_force(spark, pairs):
    check_curve(spark, pairs)


def test_sweep_edge_cases(spark):
    check_curve(spark, [(0, i / 100) for i in range(101)])
    check_curve(spark, [(1, 0.01)] * 3)
    check_curve(spark, [(1, 0.5), (0, 0.5), (1, 0.7), (0, 0.2)], grid=[0.2, 0.5, 0.7])


def auc(pairs):
    pos = [p for y, p in pairs if y == 1]
    neg = [p for y, p in pairs if y == 0]
    if not pos or not neg:
        return 0.0
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 1), rng.randint(0, 20) / 20) for _ in range(300)]
    assert E.roc_auc(frame(spark, pairs)).first()[0] == pytest.approx(auc(pairs))
    pts = E.roc_points(frame(spark, pairs)).orderBy("fpr", "tpr").collect()
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(pts, pts[1:]))
    assert area == pytest.approx(auc(pairs)) and pts[-1].tpr == 1.0
    assert E.roc_auc(frame(spark, [(1, 0.3)])).first()[0] == 0.0


def test_metrics_and_confusion(spark):
    df = frame(spark, [(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.1), (0, 0.3)])
    m = E.classification_metrics(df, meets(F.col("prob"), 0.5)).first()
    assert (m.f1, m.precision, m.recall, m.accuracy) == (0.5, 0.5, 0.5, 0.6)
    assert m.roc_auc == pytest.approx(round(4 / 6, 4))
    none = E.classification_metrics(df, meets(F.col("prob"), 2.0)).first()
    assert (none.f1, none.precision, none.recall) == (0.0, 0.0, 0.0)
    cells = {(r.actual, r.predicted): r["count"]
             for r in E.confusion_matrix(df, meets(F.col("prob"), 2.0)).collect()}
    assert cells == {(0, 0): 3, (0, 1): 0, (1, 0): 2, (1, 1): 0}


def test_regression_metrics(spark):
    y, p = np.array([1.0, 2, 4, 8]), np.array([1.5, 2, 3, 9])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    m = E.regression_metrics(df, "y", "p").first()
    e = y - p
    assert m.mae == pytest.approx(np.abs(e).mean(), abs=1e-4)
    assert m.rmse == pytest.approx(np.sqrt((e**2).mean()), abs=1e-4)
    assert m.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-4)


def test_top_models_ties_go_to_the_earlier(spark):
    best = spark.createDataFrame(
        [("c", 0.5), ("a", 0.5), ("b", 0.7), ("d", 0.1)], "model string, best_f1 double"
    )
    assert E.top_models(best, ["d", "c", "b", "a"]) == ["b", "c", "a"]


@pytest.mark.parametrize("seed", [200, 3])
def test_group_folds_cover_balance_and_stay_disjoint(spark, seed):
    rng = random.Random(seed)
    sizes = {g: rng.choice([1, 1, 2, 3, 4]) for g in range(400)} | {1000: 150}
    rows = [(g,) for g, n in sizes.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "athlete_id long").repartition(6)
    folds = FO.group_folds(df, 4)
    got = {r.athlete_id: (r.rows, r.fold) for r in folds.collect()}
    assert {g: n for g, (n, _) in got.items()} == sizes
    load = [sum(n for n, f in got.values() if f == k) for k in range(4)]
    assert max(load) - min(load) <= 1
    tagged = FO.with_folds(df, folds)
    FO.assert_folds_disjoint(tagged)
    rep = FO.fold_report(tagged, 4).collect()
    assert sum(r.val_rows for r in rep) == len(rows) and all(r.overlap == 0 for r in rep)
    assert all(r.train_entities + r.val_entities == len(sizes) for r in rep)


def test_small_folds_follow_largest_first(spark):
    sizes = {1: 4, 2: 3, 3: 3, 4: 2, 5: 1, 6: 1, 7: 1}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "athlete_id long")
    got = {r.athlete_id: r.fold for r in FO.group_folds(df, 3).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 1, 5: 2, 6: 0, 7: 2}


def greedy(sizes, k):
    loads, out = [0] * k, []
    for n in sizes:
        f = min(range(k), key=lambda i: (loads[i], i))
        loads[f] += n
        out.append(f)
    return out, loads


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 60)), min_size=1, max_size=6), st.integers(2, 7))
def test_dealing_a_histogram_is_largest_first(classes, k):
    histogram = sorted({n: c for n, c in classes}.items(), reverse=True)
    want, loads = greedy([n for n, c in histogram for _ in range(c)], k)
    got, own = [], [0] * k
    for n, c in histogram:
        starts, orders = FO._deal(own, n, c)
        assert len(starts) <= k
        for turn in range(c):
            i = max(j for j, s in enumerate(starts) if s <= turn)
            got.append(orders[i][(turn - starts[i]) % len(orders[i])])
    assert got == want and own == loads


def test_few_uneven_groups_fill_all_folds(spark):
    sizes = {1: 20_000, 2: 97, 3: 1, 4: 1, 5: 1}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "athlete_id long")
    assert {r.athlete_id: r.fold for r in FO.group_folds(df, 5).collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}
    with pytest.raises(ValueError):
        FO.group_folds(df.where("athlete_id < 4"), 5)


def test_inner_folds_deal_each_class_evenly_on_every_side(spark):
    rng = random.Random(5)
    rows = [(g, 1 if rng.random() < 0.2 else 0) for g in range(203) for _ in range(rng.choice([1, 1, 2]))]
    top = {}
    for g, y in rows:
        top[g] = max(y, top.get(g, 0))
    df = spark.createDataFrame(rows, "athlete_id long, y int")
    classes = df.groupBy("athlete_id").agg(F.max("y").alias("_class"))
    ranks = FO.inner_ranks(FO.group_folds(df, 4), classes)
    counts = {(r.fold, r._class): r.n for r in ranks.groupBy("fold", "_class").agg(F.max("_dealt").alias("n")).collect()}
    for side in range(4):
        dealt = ranks.where(F.col("fold") != side).withColumn("i", FO.inner_fold(counts, side, 3)).collect()
        for cls in (0, 1):
            n = [sum(r.i == i and r._class == cls for r in dealt) for i in range(3)]
            assert max(n) - min(n) <= 1 and sum(n) == sum(c == cls and f != side for (f, c), v in counts.items() for _ in range(v))
        assert all(top[r.athlete_id] == r._class for r in dealt)


def test_text_keys_and_overlap(spark):
    df = spark.createDataFrame([(f"e{i}",) for i in range(100)], "athlete_id string")
    folds = FO.group_folds(df, 5)
    load = sorted(r["count"] for r in folds.groupBy("fold").count().collect())
    assert load == [20] * 5
    bad = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "athlete_id long, fold int")
    assert [r.athlete_id for r in FO.fold_overlap(bad).collect()] == [1]
    assert {r.fold: r.overlap for r in FO.fold_report(bad).collect()} == {0: 1, 1: 1}
