import re

from tests.llm.frames import ODD, ascii_lower, docs, rows, text
from tidemark.llm import license_scan as L


def brute_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))


def places(w, phrase):
    p = phrase.split()
    return [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]


def brute_labels(t, rules):
    norm = " " + " ".join(brute_words(t)) + " "
    hits = []
    for i, r in enumerate(rules):
        if f" {r.keyword} " in norm:
            hits += [(m.start(), m.end(), r.priority, i, r.label) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm)]
    keep = []
    for a in hits:
        over = any(
            b[3] != a[3] and b[0] <= a[0] and b[1] >= a[1]
            and (b[2] < a[2] or (b[2] == a[2] and (b[:2] != a[:2] or b[3] < a[3])))
            for b in hits
        )
        if not over:
            keep.append(a[4])
    base = {label for p, label in L.BASE if places(brute_words(t), p)}
    return ",".join(sorted(base | set(keep)))


TEXTS = [
    "Released under the MIT License.", "mit license mit license MIT-license", "the Mit   LICENSE\nis apache license, version 2.0",
    "This work is licensed under the GNU General Public License, version 3.", "GNU Lesser General Public License v2.1 or later",
    "Licensed under CC BY-NC 4.0.", "permit license", "mit licenses", "license mit", "émit license mit license",
    "under the terms of the Mozilla Public License 2.0 and the BSD license; all rights reserved",
    "general public license " * 40, text(3000, 1) + " apache license " + text(2000, 2), "SPDX-License-Identifier: Apache-2.0 gpl v2",
]


def test_same_as_brute_force(spark):
    rules = L.signature_rules()
    assert len(rules) > 300
    table = [*ODD, *[(10 + i, t) for i, t in enumerate(TEXTS)], (10, TEXTS[0])]
    got = rows(L.scan(docs(spark, table, clash=True)))
    assert len(got) == len(table)
    texts = {d: t for d, t in table}
    for r in got:
        t = texts[r["doc_id"]]
        w = brute_words(t)
        at = sorted(p for phrase, _ in L.BASE for p in places(w, phrase))
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0], at[-1]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for p, x in L.BASE if places(w, p)}))
        assert r["labels"] == brute_labels(t, rules), t[:80]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    assert L.scan(docs(spark, [])).count() == 0


def test_detections_say_where(spark):
    (r,) = rows(L.scan(docs(spark, [(1, "x y Licensed under the Apache License, Version 2.0. z")])))
    (d,) = r["detections"]
    assert (d["label"], d["first_word"], d["n_words"], d["priority"]) == ("apache", 2, 8, 1)
