"""Window, feature and guard semantics on hand-computed frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as FT
from tidemark.operators import guards as G
from tidemark.operators import windows as WN

A = dt.date(2026, 2, 3)


def day(n):
    return A + dt.timedelta(days=n)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.fixture(scope="module")
def boundary(spark):
    offsets = [-30, -29, -14, -13, -7, -6, 0, 1]
    return spark.createDataFrame(
        [(1, day(o), float(2 ** i)) for i, o in enumerate(offsets)],
        "athlete_id long, date date, steps double",
    )


def test_window_ends_are_inclusive(boundary):
    counts = [WN.window_slice(boundary, A, d).count() for d in (30, 14, 7)]
    assert counts == [6, 4, 2]
    assert sorted(r.date for r in WN.previous_week(boundary, A).collect()) == [day(-13), day(-7)]


def test_windows_in_one_aggregate(boundary):
    s = F.col("steps")
    m = [WN.Measure(f"s{x.name}", x, "sum", s)
         for x in (WN.DAYS_30, WN.DAYS_14, WN.DAYS_7, WN.WEEK_BEFORE)]
    r = one(WN.window_agg(boundary, A, m))
    assert (r.s30d, r.s14d, r.s7d, r.sprev_7d) == (126.0, 120.0, 96.0, 24.0)


def test_rows_after_the_anchor_change_nothing(spark, boundary):
    more = boundary.unionByName(
        spark.createDataFrame([(1, day(2), 1e9)], "athlete_id long, date date, steps double")
    )
    assert one(FT.activity_features(more, A)) == one(FT.activity_features(boundary, A))


def test_missing_date_column_is_refused(spark):
    df = spark.createDataFrame([(1, 2.0)], "athlete_id long, steps double")
    with pytest.raises(KeyError):
        WN.window_slice(df, A, 7)


def test_single_row_spread_is_zero_and_absent_is_null(spark):
    df = spark.createDataFrame([(1, day(-20), 5.0)], "athlete_id long, date date, steps double")
    spine = spark.createDataFrame([(1,), (2,)], "athlete_id long")
    rows = {r.athlete_id: r for r in FT.activity_features(df, A, spine).collect()}
    assert rows[1].std_steps_30d == 0.0
    assert rows[1].std_steps_7d is None and rows[1].steps_change_7d_vs_30d is None
    assert rows[2].avg_steps_30d is None and rows[2].std_steps_30d is None


def test_absent_level_counts_zero_and_null_level_is_unknown(spark):
    df = spark.createDataFrame(
        [(1, day(0), 3.0, 4.0), (2, day(0), None, 4.0)],
        "athlete_id long, date date, very_active_minutes double, lightly_active_minutes double",
    )
    rows = {r.athlete_id: r for r in FT.activity_features(df, A).collect()}
    assert rows[1].avg_active_minutes_30d == 7.0
    assert rows[2].avg_active_minutes_30d is None


SESSION = (
    "athlete_id long, date date, sport_session_type string, start_hour double, end_hour double"
)


def test_session_length_and_weights(spark):
    df = spark.createDataFrame(
        [
            (1, day(0), "PRACTICE", 10.0, 12.0),
            (1, day(0), "gym session", 10.0, 11.0),
            (1, day(0), None, 10.0, None),
            (1, day(0), "match", 10.0, 9.0),
            (1, day(0), "yoga", 10.0, 10.0),
            (1, day(0), "Scrimmage", 8.0, 9.0),
        ],
        SESSION,
    )
    got = [
        (r.duration_hours, r.training_load)
        for r in FT.with_session_load(df).select("duration_hours", "training_load").collect()
    ]
    assert got == [(2.0, 2.0), (1.0, 1.0), (None, None), (0.5, 0.75), (0.5, 0.5), (1.0, 1.4)]
    r = one(FT.training_features(df, A))
    assert r.training_sessions_30d == 5.0
    assert (r.practice_sessions_30d, r.scrimmage_sessions_30d, r.gym_sessions_30d) == (1, 1, 1)
    assert r.training_load_7d == pytest.approx(5.65)
    assert r.training_load_change_7d_vs_previous_7d == pytest.approx(5.65 / 1e-5)


def test_no_sessions_give_zeros(spark):
    spine = spark.createDataFrame([(1,)], "athlete_id long")
    r = one(FT.training_features(spark.createDataFrame([], SESSION), A, spine))
    assert [r[c] for c in FT.TRAINING_COLUMNS] == [0.0] * 15


def test_all_null_durations_sum_to_zero(spark):
    df = spark.createDataFrame([(1, day(0), "gym", None, 2.0)], SESSION)
    r = one(FT.training_features(df, A))
    assert (r.training_sessions_30d, r.training_minutes_30d, r.gym_sessions_30d) == (0.0, 0.0, 1.0)


def test_weight_fallbacks(spark):
    logs = spark.createDataFrame(
        [
            (1, day(-3), 1, 80.0, None), (1, day(-1), 2, None, 25.0), (1, day(-3), 3, 81.0, None),
            (2, day(-40), 4, 99.0, None),
        ],
        "athlete_id long, date date, log long, weight double, bmi double",
    )
    profile = spark.createDataFrame(
        [(1, 78.0, 180.0), (2, 70.0, None)],
        "athlete_id long, weight_kg_baseline double, height_cm double",
    )
    spine = spark.createDataFrame([(1,), (2,), (3,)], "athlete_id long")
    rows = {r.athlete_id: r for r in FT.weight_features(logs, profile, A, spine, ["log"]).collect()}
    a, b, c = rows[1], rows[2], rows[3]
    assert (a.latest_weight, a.average_weight_30d, a.weight_change_30d) == (81.0, 80.5, 3.0)
    assert a.latest_bmi == 25.0 and a.latest_body_fat is None
    assert (b.latest_weight, b.average_weight_30d, b.weight_change_30d) == (70.0, 70.0, 0.0)
    assert b.latest_bmi == pytest.approx(70 / 1.75**2)
    assert c.latest_weight is None and c.weight_change_30d == 0.0 and c.latest_bmi is None


def test_duplicate_profiles_keep_one_by_order(spark):
    df = spark.createDataFrame(
        [(1, "b", 2), (1, "a", 1), (2, "c", 9)], "athlete_id long, sport string, seen int"
    )
    rows = {r.athlete_id: r for r in FT.profile_features(df, order=["seen"]).collect()}
    assert rows[1].sport == "a" and rows[2].sport == "c"
    assert rows[1].position is None
    assert FT.one_per_key(df, order=["seen"], newest=True).where("athlete_id = 1").first().sport == "b"


def test_column_guard():
    cols = ["athlete_id", "obs_window_end", "onset_day_offset", "risk_score", "posture", "steps"]
    assert G.suspicious_columns(cols, ["onset_day_offset"]) == ["risk_score", "posture"]
    assert G.suspicious_columns(["A_Future_X"]) == ["A_Future_X"]
    assert G.suspicious_columns(["a_b"], tokens=["b"]) == ["a_b"]


def test_boundary_guard(boundary):
    r = one(G.boundary_report(boundary, A))
    assert (r.rows_after, r.latest) == (1, day(1))
    with pytest.raises(G.LeakageError):
        G.assert_boundary(boundary, A)
    ok, late = G.within_boundary(boundary, A)
    assert (ok.count(), late.count()) == (7, 1)
    G.assert_boundary(ok, A)


def test_disjoint_and_unique(spark):
    a = spark.createDataFrame([(1,), (2,)], "athlete_id long")
    b = spark.createDataFrame([(2,), (3,)], "athlete_id long")
    with pytest.raises(G.LeakageError):
        G.assert_disjoint(a, b)
    G.assert_disjoint(a, b.where("athlete_id = 3"))
    twice = spark.createDataFrame([(1, 5), (1, 6)], "athlete_id long, y int")
    with pytest.raises(Exception, match="duplicate athlete_id"):
        G.assert_unique(twice).collect()
    assert G.assert_unique(b.withColumn("y", F.lit(1))).count() == 2


def test_spine_and_anchor(spark):
    empty = spark.createDataFrame([], "athlete_id long, obs_window_end date")
    meta = spark.createDataFrame([(2,), (1,), (2,), (None,)], "athlete_id long")
    assert sorted(r[0] for r in FT.entity_spine(empty, meta, None).collect()) == [1, 2]
    with pytest.raises(ValueError):
        FT.entity_spine(empty, None, None)
    labels = spark.createDataFrame([(1, day(-5)), (2, day(-9))], empty.schema)
    assert FT.anchor_of(labels, None) == day(-9)
    assert FT.anchor_of(labels, "2025-01-01 10:00") == dt.date(2025, 1, 1)
    assert FT.anchor_of(None, None) == A


def test_combined_has_the_whole_schema(spark):
    raw = {
        "daily_activity": spark.createDataFrame(
            [(1, day(0), 5.0)], "athlete_id long, date date, steps double"
        ),
        "hourly_heartrate": spark.createDataFrame(
            [(1, day(0), 60.0)], "athlete_id long, date date, heart_rate double"
        ),
        "sleep_day": spark.createDataFrame([], "athlete_id long, date date, sleep_minutes double"),
        "training_sessions": spark.createDataFrame([], SESSION),
        "weight_logs": spark.createDataFrame([], "athlete_id long, date date, weight double"),
        "athlete_metadata": spark.createDataFrame([(1, "x")], "athlete_id long, sport string"),
        "train_labels": spark.createDataFrame(
            [(1, 1, 3.0, 9.0)],
            "athlete_id long, injured_in_risk_window int, onset_day_offset double, "
            "recovery_duration double",
        ),
    }
    wide = FT.combine_features(raw)
    assert len(wide.columns) == 68 + 2 + 3
    assert len(FT.feature_columns(wide)) == 68
    r = one(wide)
    assert r.obs_window_end == A and r.min_hr_30d == 60.0 and r.onset_day_offset == 3.0
    raw["athlete_metadata"] = raw["athlete_metadata"].withColumn("team_id", F.lit("t"))
    with pytest.raises(G.LeakageError):
        G.guard_columns(wide)


def test_rolling_and_own_anchors(spark):
    rows = [(1, day(-10), 1.0), (1, day(-6), 2.0), (1, day(-6), 4.0), (1, day(0), 9.0)]
    df = spark.createDataFrame(rows, "athlete_id long, date date, v double")
    got = {r.date: (r.n_7d, r.sum_7d) for r in WN.rolling_daily(df, "v", 7).collect()}
    assert got == {day(-10): (1, 1.0), day(-6): (3, 7.0), day(0): (3, 15.0)}
    anchors = spark.createDataFrame([(1, day(-6))], "athlete_id long, obs_window_end date")
    r = one(WN.moments_at_anchors(df, anchors, "v", [WN.DAYS_7]))
    assert r.avg_7d == pytest.approx(7 / 3) and r.max_7d == 4.0
    assert r.std_7d == pytest.approx(1.5275252316519468)


def test_spread_at_own_anchor_keeps_precision(spark):
    base = 4e9
    rows = [(1, day(-i), base + x) for i, x in enumerate([0.0, 1.0, 2.0, 3.0, 1.0])]
    df = spark.createDataFrame(rows, "athlete_id long, date date, v double")
    anchors = spark.createDataFrame([(1, A)], "athlete_id long, obs_window_end date")
    r = one(WN.moments_at_anchors(df, anchors, "v", [WN.DAYS_7, WN.trailing(3)]))
    assert r.std_7d == pytest.approx(1.140175425099138, abs=1e-6)
    assert r.std_3d == pytest.approx(1.0, abs=1e-6)


# --- anchors per entity ------------------------------------------------------


@pytest.fixture(scope="module")
def at_own(spark):
    """Three entities at one, two and no anchors of their own; readings on 200 days."""
    pairs = [(1, day(0)), (2, day(-40)), (2, day(-95)), (3, None)]
    raw = {
        "daily_activity": spark.createDataFrame(
            [(e, day(-o), float(e * 1000 + o)) for e in (1, 2, 3, 4) for o in range(-5, 195, 2)],
            "athlete_id long, date date, steps double",
        ),
        "weight_logs": spark.createDataFrame(
            [(e, day(-o), 60.0 + o / 10) for e in (1, 2, 3) for o in range(0, 190, 7)],
            "athlete_id long, date date, weight double",
        ),
        "athlete_metadata": spark.createDataFrame(
            [(1, "row", 70.0), (2, "swim", 80.0)], "athlete_id long, sport string, weight_kg_baseline double"
        ),
        "train_labels": spark.createDataFrame(
            [(e, a, i % 2, float(i), float(i)) for i, (e, a) in enumerate(pairs)],
            "athlete_id long, obs_window_end date, injured_in_risk_window int, onset_day_offset double, recovery_duration double",
        ),
    }
    return raw, [(e, a or day(-95)) for e, a in pairs]


def test_each_entity_is_taken_at_its_own_anchors(at_own):
    raw, pairs = at_own
    wide = FT.combine_at_anchors(raw)
    assert len(wide.columns) == 73
    got = {(r.athlete_id, r.obs_window_end): r.asDict() for r in wide.collect()}
    assert set(got) == set(pairs)
    for e, a in pairs:
        alone = {k: v.where(F.col("athlete_id") == e) for k, v in raw.items()}
        want = one(FT.combine_features(alone, a, include_labels=False)).asDict()
        assert {k: got[e, a][k] for k in want} == want
    assert got[2, day(-95)]["recovery_duration"] == 2.0 and got[2, day(-40)]["recovery_duration"] == 1.0


def test_anchors_without_labels_table_and_without_rows(at_own, spark):
    raw, _ = at_own
    far = spark.createDataFrame([(1, dt.date(1999, 1, 1))], "athlete_id long, obs_window_end date")
    r = one(FT.combine_at_anchors({k: v for k, v in raw.items() if k != "train_labels"}, far))
    assert r.avg_steps_30d is None and r.training_load_7d == 0.0 and r.sport == "row" and r.latest_weight == 70.0
    none = far.where("false")
    assert FT.combine_at_anchors(raw, none, include_labels=False).count() == 0
    with pytest.raises(ValueError):
        FT.combine_at_anchors({"daily_activity": raw["daily_activity"]})


def test_the_range_of_all_anchors_reaches_the_scan(at_own, spark, tmp_path):
    raw, pairs = at_own
    raw["daily_activity"].write.parquet(f"{tmp_path}/a")
    anchors = spark.createDataFrame(pairs, "athlete_id long, obs_window_end date")
    windows = WN.anchor_windows(anchors, 30)
    near = WN.at_anchors(spark.read.parquet(f"{tmp_path}/a"), windows, 30)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert f"GreaterThanOrEqual(date,{day(-95 - 29)})" in plan and f"LessThanOrEqual(date,{day(0)})" in plan
    own = {(e, a) for e, a in pairs}
    want = sum(e == r.athlete_id and a - dt.timedelta(29) <= r.date <= a for e, a in own for r in raw["daily_activity"].collect())
    assert near.count() == want


def test_distinct_entities_of_every_window(spark):
    import random

    r = random.Random(3)
    rows = [(r.randrange(40) if r.random() > 0.05 else None, day(r.choice([0, 1, 2, 5, 9, 10, 25, 60])) if r.random() > 0.05 else None) for _ in range(300)]
    df = spark.createDataFrame(rows, "athlete_id long, date date").repartition(3)
    got = {(x.day, x.days): (x.exact, x.estimate) for x in WN.distinct_by_window(df, (3, 30)).collect()}
    known = [(k, d) for k, d in rows if k is not None and d is not None]
    assert len(got) == 2 * 61
    for (d, w), (exact, estimate) in got.items():
        want = len({k for k, x in known if dt.timedelta(0) <= d - x < dt.timedelta(w)})
        assert exact == want and abs(estimate - want) <= 1
    assert WN.distinct_by_window(df.where("false")).count() == 0
