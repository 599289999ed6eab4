import pytest

from tests.llm.frames import ODD, docs, rows, split_words, text
from tidemark.llm import mixing as M


def water(sizes, weights, budget, epochs=3):
    full = set()
    while True:
        left = budget - sum(epochs * sizes[s] for s in full)
        free = sum(weights[s] for s in sizes if s not in full)
        target = {s: epochs * sizes[s] if s in full else left * weights[s] / free for s in sizes}
        more = {s for s in sizes if target[s] > epochs * sizes[s] and s not in full}
        if not more:
            return target
        full |= more


TABLE = [
    *[(1000 + i, text(5 + i % 30, i), "big") for i in range(150)],
    *[(200 + i, text(7, i), "tiny") for i in range(2)],
    *[(300 + i, text(12, i), None) for i in range(9)],
    *[(400 + i, text(20, i), "Ä") for i in range(12)],
    *[(i, t, "odd") for i, t in ODD],
    (500, text(4, 1), "odd"),
    (500, text(4, 1), "odd"),
]


def test_targets_and_taken(spark):
    got = rows(M.mix(docs(spark, TABLE, clash=True)))
    assert len(got) == len(TABLE)
    sizes, weights = {}, {}
    for _, t, s in TABLE:
        sizes[s] = sizes.get(s, 0) + len(split_words(t))
    for n, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weights[s] = (1.0, 2.0, 3.0)[n % 3]
    target = water(sizes, weights, sum(sizes.values()))
    source = {d: s for d, _, s in TABLE}
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["finish"] is None) == (r["taken"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) < 1
    assert got == rows(M.mix(docs(spark, TABLE[::-1]).repartition(5))) or sorted(map(str, got)) == sorted(
        map(str, rows(M.mix(docs(spark, TABLE[::-1]).repartition(5))))
    )


def test_serving_order_is_fair(spark):
    table = [(i, text(10, i), f"s{i % 3}") for i in range(90)]
    served = rows(M.serve(M.schedule(docs(spark, table))))
    assert [r["epoch_finish"] for r in served] == sorted(r["epoch_finish"] for r in served)
    half = {}
    for r in served:
        if r["epoch_finish"] <= 0.5:
            half[r["source"]] = half.get(r["source"], 0) + r["epoch_words"]
    for r in served:
        assert abs(half[r["source"]] - r["target"] / 2) <= 10
    assert sum(r["epoch_words"] for r in served) == sum(r["taken"] for r in rows(M.mix(docs(spark, table))))


def test_given_weights_and_empty(spark):
    table = [(1, text(50, 1), "a"), (2, text(50, 2), "b"), (3, text(50, 3), None)]
    weights = spark.createDataFrame([("a", 1.0), (None, 1.0)], "source string, weight double")
    got = {r["doc_id"]: r["taken"] for r in rows(M.mix(docs(spark, table), weights=weights, budget=60))}
    assert got == {1: 30, 2: 0, 3: 30}
    assert M.mix(docs(spark, [])).count() == 0
    assert [r["taken"] for r in rows(M.mix(docs(spark, [(1, None), (2, "")])))] == [0, 0]


def test_taken_rows_keep_all_columns(spark):
    frame = docs(spark, [*TABLE, TABLE[0]], clash=True)
    got = M.taken_rows(frame)
    assert got.columns[: len(frame.columns)] == frame.columns
    seen = [(r["doc_id"], r["text"]) for r in rows(got)]
    assert len(seen) == len(set(seen)) and all(t and t.strip() for _, t in seen)
