"""The joins beyond the broadcast bound give the same rows, heavy keys included."""

import pytest
from pyspark.sql import functions as F

import tidemark.session as S
from tidemark.operators.describe import box_stats
from tidemark.operators.folds import group_folds, with_folds
from tidemark.operators.ordering import running_totals
from tidemark.operators.quantiles import exact_quantiles


@pytest.fixture
def tight(monkeypatch):
    """No table counts as small: every checked join has to shuffle."""
    monkeypatch.setattr(S, "LOCAL_ROWS", 1)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 1)


@pytest.fixture
def skewed(spark):
    rows = [(0, float(i % 97)) for i in range(600)] + [(k, float(k + i)) for k in range(1, 40) for i in range(9)]
    return spark.createDataFrame(rows, "g long, v double").repartition(5)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("sizes", [None, "n"])
def test_salted_join_equals_plain(spark, skewed, how, sizes):
    small = skewed.where("g <> 3").groupBy("g").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    side = small if sizes else small.drop("n")
    got = S.salted_join(skewed, side, ["g"], how, sizes).select("g", "v", "m")
    want = skewed.join(small, ["g"], how).select("g", "v", "m")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError):
        S.salted_join(skewed, side, ["g"], "right")


def test_settle_knows_the_size(spark, monkeypatch):
    df = spark.range(20)
    assert S.settle(df).rows is not None
    monkeypatch.setattr(S, "LOCAL_ROWS", 5)
    s = S.settle(df)
    assert s.rows is None and s.small and s.df.count() == 20
    monkeypatch.setattr(S, "BROADCAST_ROWS", 5)
    assert not S.settle(df).small


def test_operators_without_broadcast(spark, skewed, tight):
    probs = {"q": 0.25, "m": 0.5}
    wide = {r.g: (r.q, r.m) for r in exact_quantiles(skewed, "v", probs, ["g"]).collect()}
    narrow = exact_quantiles(skewed, "v", probs, ["g"], accuracy=1000, small_group=10)
    assert {r.g: (r.q, r.m) for r in narrow.collect()} == wide
    want = {
        r.g: (r.q, r.m)
        for r in skewed.groupBy("g").agg(
            F.percentile("v", 0.25).alias("q"), F.percentile("v", 0.5).alias("m")
        ).collect()
    }
    assert wide == want
    assert sum(r.n for r in box_stats(skewed, "v", ["g"]).collect()) == skewed.count()
    folds = group_folds(skewed, 4, "g")
    tagged = with_folds(skewed, folds, "g")
    assert tagged.count() == skewed.count()
    totals = running_totals(skewed.withColumn("one", F.lit(1)), [F.asc("v")], {"t": F.col("one")}, ["g"])
    assert {r.g: r.t for r in totals.groupBy("g").agg(F.max("t").alias("t")).collect()} == {
        r.g: r["count"] for r in skewed.groupBy("g").count().collect()
    }
