"""Statistics of training sides, level dictionaries and sparse one-hot rows against plain computations."""

import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import prep as P
from tidemark.operators.distributions import density_curve


def quantiles(values):
    """What a fold reports: grid quantiles that may be off by the sketch's rank error."""
    v, r = sorted(values), random.Random(len(values))
    n = len(v)
    out = []
    for i in range(P.GRID + 1):
        at = i / P.GRID * n + r.uniform(-1, 1) * n / P.ACCURACY
        out.append(v[max(0, min(n - 1, int(np.ceil(at)) - 1))])
    out[0], out[-1] = v[0], v[-1]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), min_size=1, max_size=300), min_size=1, max_size=5))
def test_brackets_hold_the_median(parts):
    whole = sorted(x for p in parts for x in p)
    low, high = P.median_bracket([(quantiles(p), len(p)) for p in parts])
    n = len(whole)
    assert low <= whole[(n - 1) // 2] and whole[n // 2] <= high


def test_brackets_are_narrow_for_many_values():
    r = random.Random(1)
    parts = [[r.gauss(m, 1) for _ in range(40_000)] for m in (0, 0.1, -0.1)]
    low, high = P.median_bracket([(quantiles(p), len(p)) for p in parts])
    whole = [x for p in parts for x in p]
    assert sum(low <= x <= high for x in whole) < 0.02 * len(whole)


@pytest.mark.parametrize("uneven", [False, True])
def test_sides_equal_their_own_rows(spark, uneven):
    r = random.Random(7)
    rows = []
    for i in range(3000):
        f = i % 4
        n = None if i % 7 == 0 else r.gauss(f * 100 if uneven else 0, 1)
        rows.append((f, n, float("nan") if i % 5 == 0 else float(r.randrange(9)), None if f != 2 else 1.5, f"l{i % 11}" if f else "only0"))
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, t string").repartition(5)
    got = P.fit_stats(df, ["a", "b", "c", "t"], [0, 1, 2, 3])
    for side, s in got.items():
        mine = [x for x in rows if x[0] != side]
        for i, c in ((1, "a"), (2, "b"), (3, "c")):
            known = [x[i] for x in mine if x[i] is not None and x[i] == x[i]]
            if not known:
                assert c not in s.medians
                continue
            med = statistics.median(known)
            filled = np.array(known + [med] * (len(mine) - len(known)))
            assert s.medians[c] == pytest.approx(med)
            assert s.means[c] == pytest.approx(filled.mean()) and s.stds[c] == pytest.approx(filled.std(), abs=1e-9)
        assert s.levels["t"] == sorted({x[4] for x in mine})


def test_no_row_is_repeated_per_side(spark, monkeypatch):
    seen = []
    long_form = P.long_form
    monkeypatch.setattr(P, "long_form", lambda *a: seen.append(long_form(*a)) or seen[-1])
    df = spark.range(100).select((F.col("id") % 5).cast("int").alias("fold"), F.col("id").cast("double").alias("x"))
    P.fit_stats(df, ["x"], list(range(5)))
    assert len(seen) == 1 and seen[0].count() == 100


@pytest.fixture(scope="module")
def clerks(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["hot"] * 30 + [f"c{r.randrange(40)}", None]), "xyz"[i % 3]) for i in range(600)]
    return spark.createDataFrame(rows, "id long, clerk string, kind string").repartition(4)


def test_sparse_rows(clerks):
    rows = clerks.collect()
    text = lambda v: P.NULL_LEVEL if v is None else v
    clerk = {v: i for i, v in enumerate(sorted({text(r.clerk) for r in rows}))}
    kind = {v: len(clerk) + i for i, v in enumerate("xyz")}
    got = {r.id: (r.size, r.slots) for r in P.one_hot_sparse(clerks, "id", ["clerk", "kind"]).collect()}
    assert got == {r.id: (len(clerk) + 3, [clerk[text(r.clerk)], kind[r.kind]]) for r in rows}


def test_wide_columns_give_the_same_vectors(clerks, spark):
    narrow = P.fit_stats(clerks, ["clerk", "kind"])[P.WHOLE]
    wide = P.fit_stats(clerks, ["clerk", "kind"], wide=5)[P.WHOLE]
    assert wide.wide == {"clerk": len(narrow.levels["clerk"])} and wide.levels == {"kind": ["x", "y", "z"]}
    new = spark.createDataFrame([(1, "hot", "x"), (2, "never seen", "z"), (3, None, "y"), (4, "c1", None)], clerks.schema)
    dictionary = P.level_dictionary(clerks, ["clerk"])
    vec = lambda df, s: {
        r.id: dict(zip(P.feature_names(s), r.v))
        for r in P.build_prep(df, s, False).transform(df).select("id", vector_to_array("features").alias("v")).collect()
    }
    a, b = vec(new, narrow), vec(P.with_slots(new, dictionary, wide.wide), wide)
    slots = {r.level: f"clerk#{r.slot}" for r in dictionary.collect()}
    for i in a:
        assert {(slots[k[6:]] if k.startswith("clerk_") else k): v for k, v in a[i].items()} == b[i]


def test_density_of_a_long_tail_is_the_plain_sum(spark):
    r = random.Random(2)
    values = {"tail": [r.paretovariate(1.1) for _ in range(800)], "two": [r.gauss(m, 0.1) for m in (0, 50) for _ in range(200)]}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("one", 1.0), ("same", 2.0), ("same", 2.0)]
    rows += [("tail", float("nan")), ("tail", None), ("two", float("inf"))]
    got = density_curve(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], 50).collect()
    assert {x.k for x in got} == set(values) and len(got) == 100
    for x in got:
        v = np.array(values[x.k])
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-0.5 * ((x.x - v) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi))
        assert x.density == pytest.approx(want, abs=1e-8 / h)
