import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.functions import clip, half_even_int, parse_moment
from tidemark.operators import quality as Q
from tidemark.sources import files, readers, sinks


def write(folder, name, text):
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_headers_exact_before_any_case():
    assert schema.Headers(["ATHLETE_ID", "Id"]).take("athlete_id") == "Id"
    assert schema.Headers(["Id", "athlete_id"]).take("athlete_id") == "athlete_id"
    assert schema.Headers(["ATHLETE_ID"]).take("athlete_id") == "ATHLETE_ID"
    assert schema.Headers(["x"]).take("steps") is None
    with pytest.raises(KeyError):
        schema.Headers(["x"]).need("steps")


def test_tables_from_csv(spark, tmp_path):
    d = str(tmp_path)
    write(d, "DAILYACTIVITY_merged.csv",
          "Id,ActivityDate,TotalSteps,Calories\n1,2026-02-03,NA,5\n2,2/3/2026,inf,-5\n3,bad,nan,\n")
    write(d, "hourlyHeartrate_merged.csv",
          "Id,ActivityHour,AvgHeartRate\n1,2026-02-03 23:00:00,60\n1,2026-02-03T01:00:00,null\n")
    write(d, "training_sessions.csv",
          'id,session_id,date,type,start,end\n1,s1,2026-02-01,"gym, big",8,9.5\n')
    write(d, "athlete_metadata.csv", "athlete_id,Sport,height\n1,run,N/A\n")
    write(d, "train_labels.csv", "athlete_id,injury,onset\n1,1,4\n")
    raw = readers.load_raw(spark, d, "2026-02-03")
    act = {r.athlete_id: r for r in raw["daily_activity"].collect()}
    assert act[1].steps is None and act[1].calories == 5.0
    assert act[2].steps == float("inf") and act[2].date == dt.date(2026, 2, 3)
    assert act[3].date is None and act[3].steps is None
    hr = raw["hourly_heartrate"].orderBy("datetime").collect()
    assert [r.datetime.hour for r in hr] == [1, 23] and {r.date for r in hr} == {dt.date(2026, 2, 3)}
    assert raw["sleep_day"].count() == 0 and "sleep_minutes" in raw["sleep_day"].columns
    s = raw["training_sessions"].first()
    assert (s.session_id, s.sport_session_type, s.end_hour) == ("s1", "gym, big", 9.5)
    assert raw["athlete_metadata"].first().height_cm is None
    lab = raw["train_labels"].first()
    assert (lab.injured_in_risk_window, lab.onset_day_offset) == (1, 4.0)
    assert lab.obs_window_end == dt.date(2026, 2, 3)
    with pytest.raises(KeyError):
        readers.load_table(spark, d, "train_labels", None).columns
    seen = {r.table: r.exists for r in files.presence(spark, d).collect()}
    assert len(seen) == 10 and seen["train_labels"] and not seen["hourly_steps"]


def test_required_files_and_keys(spark, tmp_path):
    d = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        readers.load_table(spark, d, "daily_activity")
    write(d, "athlete_metadata.csv", "id,sport\nabc,run\n")
    with pytest.raises(Exception, match="entity key"):
        readers.load_table(spark, d, "athlete_metadata").collect()


def test_feature_source_order(spark, tmp_path):
    p = str(tmp_path / "f")
    sinks.write_features(spark.range(3), p)
    assert readers.feature_source(spark, None, precomputed=p).count() == 3
    assert readers.feature_source(spark, None, str(tmp_path / "no"), None, p).count() == 3
    with pytest.raises(FileNotFoundError):
        readers.feature_source(spark, None, None, None, str(tmp_path / "no"))


def test_importances_roundtrip(spark, tmp_path):
    p = str(tmp_path / "imp")
    df = spark.createDataFrame([("a", 1.5), ("b", 0.25)], readers.IMPORTANCE_SCHEMA)
    sinks.write_csv(df, p)
    assert sorted(map(tuple, readers.read_importances(spark, p).collect())) == [("a", 1.5), ("b", 0.25)]


def test_parse_moment(spark):
    df = spark.createDataFrame(
        [("2026-02-03",), ("2026-02-03T05:06:07",), ("4/12/2016 11:59:59 PM",), ("nope",), (None,)],
        "t string",
    )
    got = [r.m for r in df.select(parse_moment(F.col("t")).alias("m")).collect()]
    assert got == [
        dt.datetime(2026, 2, 3), dt.datetime(2026, 2, 3, 5, 6, 7),
        dt.datetime(2016, 4, 12, 23, 59, 59), None, None,
    ]


def test_clip_and_round(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.5, 1.5, 2.5, 31.0, None)], "x double")
    got = [r.y for r in df.select(half_even_int(clip(F.col("x"), 0.0, 30.0)).alias("y")).collect()]
    assert got == [0, 0, 2, 2, 30, None]


def test_audits(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None), (1, float("nan"), "a"), (2, float("-inf"), None), (2, -5.0, None)],
        "athlete_id long, x double, t string",
    )
    nulls = [tuple(r) for r in Q.null_audit(df).collect()]
    assert nulls == [("t", 3, 75.0), ("x", 1, 25.0)]
    assert Q.duplicate_count(df, ["athlete_id", "nope"]).first()[0] == 2
    assert Q.duplicate_count(df, ["nope"]).first()[0] == 0
    a = {r.column: r for r in Q.anomaly_audit(df).collect()}
    assert (a["x"].negative_count, a["x"].infinite_count, a["x"].max_val) == (2, 1, 1.0)
    none = spark.createDataFrame([], "athlete_id long, x double")
    rep = {r.table: r for r in Q.table_audit({"t": df, "e": none}).collect()}
    assert rep["t"].rows == 4 and rep["t"].duplicates == 2 and rep["t"].missing_columns_count == 2
    assert rep["e"].status == "EMPTY_OR_NOT_FOUND" and rep["e"].anomalies == []
