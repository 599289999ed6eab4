import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.ordering import global_rank, running_totals
from tidemark.operators.quantiles import exact_quantiles


def test_global_rank_matches_sorted_order(spark):
    rows = [(i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, s long").repartition(7)
    got = {r.k: r["rank"] for r in global_rank(df, [F.desc("s"), F.asc("k")]).collect()}
    want = {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert got == want


def test_running_totals_by_group(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.randint(0, 9)) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(5)
    got = {
        (r.g, r.i): r.t
        for r in running_totals(df, [F.asc("i")], {"t": F.col("v")}, ["g"]).collect()
    }
    want = {}
    for g in "ab":
        total = 0
        for gg, i, v in rows:
            if gg == g:
                total += v
                want[(g, i)] = total
    assert got == want


@pytest.mark.parametrize("small,one_task", [(200_000, 5_000_000), (10, 5_000_000), (10, 0)])
def test_quantiles_equal_numpy(spark, small, one_task):
    rng = np.random.default_rng(5)
    a = np.round(rng.lognormal(3, 2, 9000), 3)
    b = np.concatenate([np.full(3000, 7.0), rng.normal(0, 1, 101)])
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "q1": 0.25, "med": 0.5, "q3": 0.75, "p1": 1.0}
    got = {
        r.g: r
        for r in exact_quantiles(
            df, "v", probs, ["g"], accuracy=1000, small_group=small, one_task_values=one_task
        ).collect()
    }
    for g, arr in (("a", a), ("b", b), ("c", np.array([1.0]))):
        for n, p in probs.items():
            assert got[g][n] == pytest.approx(np.quantile(arr, p), abs=1e-9)
    assert got["d"]["med"] is None


def test_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    r = exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75}).collect()[0]
    assert (r.a, r.b, r.c) == (1.75, 2.5, 3.25)
    empty = exact_quantiles(df.where("v > 9"), "v", {"m": 0.5}).collect()
    assert [r.m for r in empty] == [None]
