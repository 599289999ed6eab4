import datetime as dt

from pyspark.sql import functions as F

from tidemark.plans import bindings as B
from tidemark.streaming import jobs as ST


def stream(spark, sf):
    s = ST.read_stream(spark, f"{sf}/events.parquet", B.table(spark, sf, "events").schema)
    return s.select(F.col("user_id").alias("athlete_id"), "ts", "event_type", "value")


def test_rollup_emits_exactly_the_closed_days(spark, sf, tmp_path):
    out = str(tmp_path / "o")
    ST.run_available(ST.daily_rollup(stream(spark, sf), "value"), out, str(tmp_path / "c"))
    e = B.table(spark, sf, "events")
    last = e.agg(F.max("ts")).first()[0] - dt.timedelta(days=2)
    day = F.col("ts").cast("date")
    want = (
        e.groupBy(F.col("user_id"), day.alias("d")).agg(F.count("*").alias("n"))
        .where(F.date_add("d", 1).cast("timestamp_ntz") <= F.lit(last).cast("timestamp_ntz"))
    )
    got = spark.read.parquet(out).select("athlete_id", F.col("start").cast("date"), "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rollup_continues_from_its_checkpoint(spark, sf, tmp_path):
    out, log = str(tmp_path / "o"), str(tmp_path / "c")
    ST.run_available(ST.daily_rollup(stream(spark, sf), "value"), out, log)
    n = spark.read.parquet(out).count()
    ST.run_available(ST.daily_rollup(stream(spark, sf), "value"), out, log)
    assert spark.read.parquet(out).count() == n


def test_gate_keeps_every_row_once(spark, sf, tmp_path):
    p = str(tmp_path)
    s = stream(spark, sf).withColumn("date", F.col("ts").cast("date"))
    seen = [ST.gate_metrics(ST.gate(s, B.ANCHOR_DAY, f"{p}/ok", f"{p}/late", f"{p}/c")) for _ in range(2)]
    ok, late = spark.read.parquet(f"{p}/ok"), spark.read.parquet(f"{p}/late")
    assert ok.count() + late.count() == B.table(spark, sf, "events").count()
    assert seen[0] == {"rows": ok.count() + late.count(), "rows_after": late.count(), "latest": late.agg(F.max("date")).first()[0]}
    assert seen[1]["rows"] == 0 and seen[1]["latest"] is None
    assert ok.agg(F.max("date")).first()[0] <= B.ANCHOR_DAY < late.agg(F.min("date")).first()[0]


def test_scores_stream_through(spark, tmp_path):
    p = str(tmp_path)
    spark.createDataFrame([(1, 0.2), (2, 0.9)], "athlete_id long, x double").write.parquet(f"{p}/in")
    rows = spark.readStream.schema("athlete_id long, x double").parquet(f"{p}/in")
    ST.score_stream(rows, lambda d: d.withColumn("prob", F.col("x")), 0.5, f"{p}/o", f"{p}/c")
    got = {r.athlete_id: r.status for r in spark.read.parquet(f"{p}/o").collect()}
    assert got == {1: "Low Risk", 2: "High Risk"}
