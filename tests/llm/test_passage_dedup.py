import random

import numpy as np

from tests.llm.frames import ODD, ascii_lower, docs, rows, split_words, text, words
from tidemark.llm import passage_dedup as P


def edited(w, n, seed):
    r = random.Random(seed)
    w = w[:]
    for _ in range(n):
        i = r.randrange(len(w))
        k = r.randrange(3)
        if k == 0:
            w[i] = "q%d" % r.randrange(10**6)
        elif k == 1:
            w.insert(i, "q%d" % r.randrange(10**6))
        else:
            del w[i]
    return w


def shared_runs(table, n=P.MIN_WORDS):
    """Brute force: ids of texts that share a run of ``n`` words with another."""
    seen = {}
    for d, t in table:
        w = split_words(ascii_lower(t))
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(d)
    return {d for ids in seen.values() if len(ids) > 1 for d in ids}


def test_exact_and_fuzzy_passages(spark):
    passage, other = words(70, 1), words(55, 2)
    table = list(ODD)
    for i in range(30):  # a shared passage among fresh words
        table.append((100 + i, " ".join(words(40, 10 + i) + passage + words(25, 60 + i)).upper()))
    for i in range(12):  # fuzzy ones
        table.append((200 + i, " ".join(words(30, 200 + i) + edited(words(120, 3), 7, i) + words(30, 300 + i))))
    table += [(300, " ".join(other)), (301, " ".join(words(9, 4) + other)), (302, " ".join(other))]
    table += [(400 + i, text(300, 400 + i) + " " + " ".join(passage[:20])) for i in range(15)]  # too short
    table += [(500, " ".join(words(60, 5) * 3)), (501, text(80, 7))]  # repeats itself only
    table += [(600, text(5000, 8)), (601, text(10, 9) + " " + text(5000, 8) + " " + text(10, 10)), (601, "x")]
    got = rows(P.repeated_passages(docs(spark, [*table, table[-3]], clash=True)))
    flagged = {r["doc_id"] for r in got} | {r["home_id"] for r in got}
    must = shared_runs(table)
    assert must <= flagged
    assert flagged == must | {200 + i for i in range(12)}
    by = {d: split_words(ascii_lower(t)) for d, t in table if d != 601}
    for r in got:
        assert r["doc_id"] != r["home_id"] and r["same"] >= P.MIN_SAME
        assert min(r["end"] - r["start"], r["home_end"] - r["home_start"]) >= P.MIN_WORDS
        if r["doc_id"] in range(100, 130):
            a = by[r["doc_id"]][r["start"] : r["end"]]
            assert len(a) >= 70 and a == by[r["home_id"]][r["home_start"] : r["home_end"]]
        if r["doc_id"] == 601:
            assert r["end"] - r["start"] == 5000
    for i in range(1, 12):
        assert sum(r["end"] - r["start"] for r in got if r["doc_id"] == 200 + i) >= 100


def test_chain_scores_are_the_best():
    """The Fenwick chain has the score of the quadratic programme."""
    r = random.Random(3)
    for _ in range(60):
        pts = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randint(1, 14))})
        x, y = [a for a, _ in pts], [b for _, b in pts]

        def cost(p, i):
            return P.GAP * (x[i] - x[p] + y[i] - y[p])

        best = [float(P.K)] * len(pts)
        for i in range(len(pts)):
            for p in range(i):
                if x[p] < x[i] and y[p] < y[i]:
                    best[i] = max(best[i], best[p] + P.K - cost(p, i))
        found = P.chains(x, y)
        assert sorted(i for c in found for i in c) == list(range(len(pts)))
        chain = found[0]
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(chain, chain[1:]))
        assert abs(P.K * len(chain) - sum(cost(a, b) for a, b in zip(chain, chain[1:])) - max(best)) < 1e-9


def test_align_along_a_chain():
    r = random.Random(8)
    for _ in range(40):
        a = [r.randrange(10**6) for _ in range(150)]
        b = a[:]
        for at in (40, 75, 110):
            if r.random() < 0.3:
                del b[at]
            elif r.random() < 0.5:
                b.insert(at, 5)
            else:
                b[at] = 6
        left, right = [7] * r.randrange(5), [8] * r.randrange(5)
        x, y = np.array([1] * 3 + a + [2] * 4), np.array(left + b + right)
        where = {tuple(y[i : i + P.K].tolist()): i for i in range(len(y) - P.K + 1)}
        seeds = [(i, where[t]) for i in range(0, len(x) - P.K + 1, 5) if (t := tuple(x[i : i + P.K].tolist())) in where]
        i, j, p, q, same = P.align(x, y, [s for s, _ in seeds], [s for _, s in seeds])
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for m, u in enumerate(a, 1):
            for n, v in enumerate(b, 1):
                table[m][n] = table[m - 1][n - 1] + 1 if u == v else max(table[m - 1][n], table[m][n - 1])
        assert (i, j, p, q) == (3, 3 + len(a), len(left), len(left) + len(b))
        assert same == table[-1][-1]


def test_empty(spark):
    assert P.repeated_passages(docs(spark, [])).count() == 0
    assert P.repeated_passages(docs(spark, ODD)).count() == 0


def test_seeds_of_a_passage_have_different_homes(spark):
    passage, row = words(60, 31), words(70, 32)
    table = [
        (1, " ".join(words(30, 41) + passage[:45] + words(30, 42))),
        (2, " ".join(words(30, 43) + passage[15:] + words(30, 44))),
        (3, " ".join(words(20, 45) + passage + words(20, 46))),
        (4, " ".join(words(25, 47) + passage + words(35, 48))),
        # the home has parts of the passage before the whole of it
        (5, " ".join(words(9, 49) + row[40:] + words(9, 50) + row[:40] + words(30, 51) + row)),
        (6, " ".join(words(12, 52) + row + words(12, 53))),
    ]
    got = rows(P.repeated_passages(docs(spark, table, clash=True)), "doc_id", "start")
    met = {(r["doc_id"], r["home_id"]): r for r in got if r["end"] - r["start"] >= 60}
    assert {(r["doc_id"], r["home_id"]) for r in got} == {(4, 3), (6, 5)}
    r = met[4, 3]
    assert (r["start"], r["end"], r["home_start"], r["home_end"], r["same"]) == (25, 85, 20, 80, 1.0)
    assert any(r["doc_id"] == 6 and (r["start"], r["end"]) == (12, 82) for r in got)


def test_ends_do_not_take_a_passage_below_the_limit():
    a = np.arange(120)
    b = a.copy()
    b[[x for x in range(120) if not 35 <= x < 85 and x % 9 in (1, 3, 5, 7)]] = 500  # five of nine are equal
    x = np.arange(35, 78, 6)
    i, j, p, q, same = P._passage(a, b, x, x, P.MIN_WORDS, P.MIN_SAME)
    assert i <= 35 and j >= 85 and (i, j) == (p, q) and same >= P.MIN_SAME


def test_seeds_of_many_texts_at_once():
    r = random.Random(5)
    for _ in range(200):
        sizes = [r.choice([0, 3, 8, 9, 19, 20, 21, 40, 100]) for _ in range(r.randint(1, 6))] + [8]
        h = np.array([r.randrange(r.choice([2, 2**63])) for _ in range(sum(sizes))], np.uint64)
        at = np.cumsum([0, *sizes])
        want = [int(a + p) for a, n in zip(at, sizes) if n >= P.K for p in P.winnow(h[a : a + n])]
        begin, end = at[:-1], np.maximum(at[:-1], at[1:] - P.K + 1)
        assert P.winnow_all(P.runs(h, P.K), begin, end).tolist() == want


def test_lone_seeds_align_as_chains_of_one():
    r = random.Random(6)
    flat = np.array([r.randrange(4) for _ in range(4000)], np.uint32)
    x, y = np.array([r.randrange(10, 1900) for _ in range(300)]), np.array([r.randrange(2010, 3900) for _ in range(300)])
    for a, b in zip(x.tolist(), y.tolist()):
        flat[b - 26 : b + 34] = np.where(np.array([r.random() < 0.85 for _ in range(60)]), flat[max(a - 26, 0) : max(a - 26, 0) + 60], 9)
        flat[b : b + P.K] = flat[a : a + P.K]
    x0, x1 = np.maximum(x - r.randrange(30), 0), x + P.K + np.array([r.randrange(10, 40) for _ in x])
    y0, y1 = y - np.array([r.randrange(10, 40) for _ in y]), y + P.K + 30
    good, found = P._lone_passages(flat, x, x0, x1, y, y0, y1, 40, 0.8)
    want = []
    for i in range(len(x)):
        lo, hi = max(x0[i], x[i] - P.REACH), min(x1[i], x[i] + P.K + P.REACH)
        low, high = max(y0[i], y[i] - P.REACH), min(y1[i], y[i] + P.K + P.REACH)
        got = P._passage(flat[lo:hi], flat[low:high], x[i : i + 1] - lo, y[i : i + 1] - low, 40, 0.8)
        assert good[i] == (got is not None)
        if got:
            want.append((got[0] + lo, got[1] + lo, got[2] + low, got[3] + low, got[4]))
    assert want and [tuple(r) for r in zip(*(c.tolist() for c in found))] == want


def test_needed_runs_cover_the_same_words():
    r = random.Random(7)
    for _ in range(300):
        runs = sorted(((r.randrange(3), r.randrange(2), a := r.randrange(60), a + r.randrange(5, 20)) for _ in range(r.randint(1, 25))), key=lambda v: (*v[:3], -v[3]))
        kept = P.needed_runs(*(np.array(c) for c in zip(*runs)))
        covers = [{(d, h, w) for d, h, a, b in some for w in range(a, b)} for some in (runs, [runs[i] for i in kept])]
        assert covers[0] == covers[1] and len(set(kept)) == len(kept)
