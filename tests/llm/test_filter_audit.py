import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.frames import ODD, docs, rows, split_words, text
from tidemark.llm import filter_audit as M

LABELS = "doc_id long, quality int, toxic int"


def failures(table):
    out = []
    for r in table:
        doc_id, t = r[0], r[1] or ""
        w = split_words(t)
        smaller = [o for o in table if o[0] is not None and doc_id is not None and o[0] < doc_id]
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search("[#$%&*|]", t):
            fails.add("D")
        if any((o[1] or "") == t for o in smaller):
            fails.add("E")
        out.append(fails)
    return out


def brute(table, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    bad = {d for d, _, t in labels if t == 1 and d is not None}
    fails = failures(table)
    out = {}
    for part in {r[2] or "" for r in table}:
        mine = [(r[0], f) for r, f in zip(table, fails) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for i, f in enumerate(order):
                before = set(order[:i])
                gone = [d for d, x in mine if f in x and not x & before]
                total[f] += len(gone)
                out[part, order, i + 1] = [
                    sum(not x & (before | {f}) for _, x in mine),
                    len(gone),
                    sum(f in x and bool(x & before) for _, x in mine),
                    sum(x == {f} for _, x in mine),
                    sum(d in good for d in gone),
                    sum(d in bad for d in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


NAMES = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def compare(spark, table, labels, clash=False):
    got = rows(M.audit(docs(spark, table, clash), spark.createDataFrame(labels, LABELS)))
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in NAMES] for r in got} == brute(table, labels)
    assert len(got) == 600 * len({r[2] or "" for r in table})


def mixed_texts(n):
    out = []
    for i in range(n):
        t = text(260 if i % 2 else 40, i // 3)
        if i % 5 == 0:
            t += " # rule"
        if i % 4 == 0:
            t = t.upper()[: 30 + i] + t
        if i % 7 == 0:
            t = "lo mi " * (130 if i % 2 else 10)
        out.append(t)
    return out


TABLE = [
    *[(1000 + i, t, ("big", "big", "small", None, "")[i % 5]) for i, t in enumerate(mixed_texts(90))],
    *[(2000 + i, text(30, 7), "hot") for i in range(60)],
    *[(i, t, "odd") for i, t in ODD],
    (None, text(30, 7), "odd"),
    (None, None, None),
    (2000, text(30, 7), "hot"),
    (2000, "other", "hot"),
]
MARKS = [(1000 + i, i % 2, (i % 3 == 0) * 1) for i in range(0, 90, 2)] + [
    (2001, 1, 1),
    (2001, 0, 0),
    (None, 1, 1),
    (2005, None, None),
]


@pytest.mark.parametrize("clash", [False, True])
def test_same_as_brute_force(spark, clash):
    compare(spark, TABLE, MARKS, clash)


def test_no_labels_and_one_row(spark):
    compare(spark, [(7, text(9, 1), "s")], [])


def test_very_long_text(spark):
    compare(spark, [(1, "Ab # " * 300_000, "s"), (2, "x" * 2_000_000, "s"), (3, "x" * 2_000_000, "t")], [(2, 1, 1)])


def test_empty_table(spark):
    assert rows(M.audit(docs(spark, []), spark.createDataFrame([], LABELS))) == []


def test_relations_leave_nothing_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    M.audit(docs(spark, TABLE[:20]), spark.createDataFrame(MARKS, LABELS)).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_joins_of_relations_need_no_shuffle(spark):
    tables = M.Relations(docs(spark, []), "audit-test", 4)
    wide = spark.range(5000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("f"))
    kept = tables.keep(tables.deal(wide), "x", "f")
    plan = kept.where("f = 'a'").hint("merge").join(kept.where("row_id % 2 = 0").select("row_id"), "row_id", "left_anti")
    assert plan.count() == 833
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    tables.drop()
