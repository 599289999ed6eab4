import random
import re

import numpy as np

from tests.llm.frames import ODD, docs, rows, text
from tidemark.llm import decontaminate as D


def canon(t):
    return (" " + re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")).strip() + " ").encode()


def fewest_edits(item, region):
    """Plain dynamic programme: item against any part of the region."""
    row = [0] * (len(region) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(region, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(t, n, r):
    t = list(t)
    for _ in range(n):
        i = r.randrange(len(t))
        k = r.randrange(3)
        if k == 0:
            t[i] = r.choice("abcdefgh")
        elif k == 1:
            t.insert(i, r.choice("abcdefgh"))
        else:
            del t[i]
    return "".join(t)


def items(spark, table):
    return spark.createDataFrame(table, "item_id long, text string")


def test_same_as_brute_force(spark):
    r = random.Random(2)
    bench = [(i, text(n, 500 + i)) for i, n in enumerate([8, 15, 30, 45, 60])] + [(6, None), (7, ""), (8, "ab?"), (9, "--")]
    table = list(ODD)
    for i in range(60):
        k = r.randrange(5)
        t = bench[k][1]
        table.append((100 + i, text(r.randint(0, 80), i) + " " + edit(t, r.choice([0, 1, 3, len(t) // 12, len(t) // 6]), r).upper() + "\n" + text(30, 900 + i)))
    table.append((300, f"x {bench[2][1]} y {bench[2][1]} z, AB."))
    table.append((300, f"x {bench[2][1]} y {bench[2][1]} z, AB."))
    got = rows(D.contaminated(docs(spark, table, clash=True), items(spark, bench)))
    found = {(g["doc_id"], g["item_id"]): g["edits"] for g in got}
    texts = {d: t for d, t in table}
    for d, t in texts.items():
        for i, item in bench:
            c = canon(item)
            if len(c) < 3:
                assert (d, i) not in found
                continue
            size = np.array(len(c))
            budget = min(int(D.RATE * (size - 2)), max((int(size) - D.Q) // D.Q, 0)) if size >= D.Q else 0
            best = fewest_edits(c, canon(t))
            assert ((d, i) in found) == (best <= budget), (d, i, best, budget)
            if (d, i) in found:
                assert found[d, i] == best
    spans = sorted((g["start"], g["end"]) for g in got if g["doc_id"] == 300 and g["item_id"] == 2)
    raw = texts[300].encode()
    assert len(spans) == 4 and {canon(raw[a:b].decode()) for a, b in spans} == {canon(bench[2][1])}


def test_blocks_and_empty(spark, monkeypatch):
    bench = items(spark, [(i, text(30, 40 + i)) for i in range(6)])
    table = docs(spark, [(i, text(20, i) + " " + text(30, 40 + i)) for i in range(6)])
    whole = rows(D.contaminated(table, bench), "doc_id")
    monkeypatch.setattr(D, "BLOCK_BYTES", 400)
    assert rows(D.contaminated(table, bench), "doc_id") == whole and len(whole) == 6
    assert D.contaminated(docs(spark, []), bench).count() == 0
    assert D.contaminated(table, bench.limit(0)).count() == 0
