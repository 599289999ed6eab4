import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.frames import ODD, ascii_lower, docs, rows, split_words, text, words
from tidemark.llm import ngram_join as N


def shingles(t, k=4):
    w = split_words(ascii_lower(t))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute(table, percent=85, k=4):
    sets = [(d, shingles(t, k)) for d, t in table]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        n = len(a & b)
        if a and b and 100 * n >= percent * (len(a) + len(b) - n):
            up[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(sets):
        low.setdefault(find(i), []).append(d)
    key = lambda d: (d is None, d or 0)
    return sorted(((d, len(s), min((x for x in low[find(i)] if x is not None), default=None) if s else d) for i, (d, s) in enumerate(sets)), key=str)


def family(base, n, seed, edits):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = "x%d" % r.randrange(10**6)
        out.append(" ".join(w))
    return out


def check(spark, table, monkey=None):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows(N.similar_components(docs(spark, table, clash=True)))]
    assert sorted(got, key=str) == brute(table)


def test_chains_copies_and_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 600)  # many blocks
    monkeypatch.setattr(N, "REST_SHINGLES", 900)
    passage = words(60, 9)
    table = [*ODD, (6, "One"), (7, "two three"), (8, "Two\tthree"), (8, "two three")]
    texts = family(words(150, 1), 14, 2, 4) + family(words(30, 3), 8, 4, 1)
    # a chain: each text differs a little from the one before
    w = words(120, 5)
    for i in range(10):
        w = w[:]
        w[(11 * i) % 120] = f"y{i}"
        texts.append(" ".join(w))
    texts += [" ".join(passage + words(n, 100 + n)) for n in range(20, 80, 6)]  # share a passage only
    table += [(100 - i, t) for i, t in enumerate(texts)] + [(200, texts[0]), (201, texts[0].upper())]
    check(spark, table)


def test_empty_table(spark):
    assert N.similar_components(docs(spark, [])).count() == 0
    assert [r["component_id"] for r in rows(N.similar_components(docs(spark, [(3, None), (3, "")])))] == [3, 3]


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    r = np.random.default_rng(1)
    for _ in range(400):
        n = int(r.integers(1, 500))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        drop = int(r.integers(0, max(1, len(a) * (100 - percent) // 100) + 1))
        add = int(r.integers(0, 3 + len(a) // 20))
        b = np.unique(np.concatenate([a[drop:], r.integers(0, 2**63, add).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(N.signatures(a, percent), N.signatures(b, percent)))


def test_divide_skip_counts_like_a_full_merge():
    r = random.Random(4)
    sets = [np.array(sorted(r.sample(range(90), r.randint(5, 60))), np.uint64) for _ in range(60)]
    sets += [s[: max(4, len(s) - 2)] for s in sets[:30]]
    comps = list(range(len(sets)))
    for links in (N.search(sets, comps, 85), N.search_rest(sets, comps, comps, 85)):
        forest = N.Forest()
        for a, b in links:
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            assert 100 * len(x & y) >= 85 * len(x | y)
            forest.join(a, b)
        for a, b in combinations(range(len(sets)), 2):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if 100 * len(x & y) >= 85 * len(x | y):
                assert forest.find(a) == forest.find(b)


def test_groups_of_the_last_search_are_bounded(spark):
    members = [(7, f, f % 5) for f in range(60)]
    everyone = spark.createDataFrame(members, "anchor long, fp long, comp long")
    asking = everyone.where("fp % 4 <> 0")
    sizes = spark.createDataFrame([(f, 100) for f in range(60)], "fp long, n_shingles long")
    groups = {}
    for r in N.rest_groups(everyone, asking, sizes, 1000).collect():
        groups.setdefault((r["anchor"], r["block"]), []).append((r["fp"], r["asks"]))
    met = {(a, b) for g in groups.values() for a, asks in g if asks for b, _ in g if a != b}
    assert met == {(a, b) for a in range(60) if a % 4 for b in range(60) if a != b}
    assert len(groups) == 6 * 5 and max(map(len, groups.values())) < 45


def test_links_of_texts_without_an_id(spark):
    w = words(100, 1)
    bridge, a, b = w, w[:93], w[7:]  # 90 of 97 shingles each with the bridge, 83 of 97 between them
    other = words(80, 2)
    table = [(1, " ".join(a)), (None, " ".join(bridge)), (2, " ".join(b)), (None, " ".join(other)), (None, " ".join(other[1:]))]
    check(spark, [*table, (9, text(50, 3))])
    low = {r["doc_id"]: r["component_id"] for r in rows(N.similar_components(docs(spark, table), k=4, percent=90))}
    assert (low[1], low[2]) == (1, 1)


def test_copies_of_texts_are_shuffled_in_turns(spark, monkeypatch):
    """As many copies a turn as there are texts, about, and the links of all groups at once."""
    base = words(60, 71)
    every = family(base, 12, 3, 2)
    texts = spark.createDataFrame([(i, t, hash(t)) for i, t in enumerate(every)], "fp long, text string, n_text long")
    members = [(a, b, f, f, True) for a in range(12) for b in range(2) for f in {a, *range(b, 12, 2)}]
    asked = spark.createDataFrame(members, "anchor long, block long, fp long, comp long, asks boolean")
    whole, sizes = N._links, []

    def counted(part, *more):
        sizes.append(part.count())
        return whole(part, *more)

    want = {(r["a"], r["b"]) for r in whole(asked, texts, 4, 60, "anchor").collect()}
    monkeypatch.setattr(N, "_links", counted)
    got = {(r["a"], r["b"]) for r in N._links_in_turns(asked, texts, 4, 60, "anchor").collect()}
    assert want and got == want
    assert sum(sizes) == len(members) and max(sizes) < len(members) / 3


def test_sketches_differ_no_more_than_sets():
    r = np.random.default_rng(7)
    sets = []
    for n in (1, 5, 42, 43, 90, 300):  # numbers of bins change at 42 and between 300 and its copies
        base = r.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(12):
            own = r.integers(0, 2**63, int(r.integers(0, 2 + n // 3))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([base[: len(base) - int(r.integers(0, 1 + n // 8))], own])))
    sets.append(np.unique(np.concatenate([sets[-1], r.integers(0, 2**63, 50).astype(np.uint64)])))
    comps = np.arange(len(sets))
    linked = set()
    for a, b in combinations(range(len(sets)), 2):
        n = len(np.intersect1d(sets[a], sets[b]))
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            linked |= {(a, b), (b, a)}
    sizes, bits = np.array([len(s) for s in sets]), [N.sketch(s) for s in sets]
    assert linked and any(len(bits[a]) != len(bits[b]) for a, b in linked)
    for a in range(len(sets)):  # one asks, as in the last two searches
        hit = N.possible(sizes, bits, comps, comps == a, 80)
        assert {b for x, b in linked if x == a} <= set(np.flatnonzero(hit).tolist())
    assert not N.possible(sizes, bits, comps * 0, comps >= 0, 80).any()  # connected already
    far = [np.unique(r.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(20)]
    alone = N.possible(np.full(20, 200), [N.sketch(s) for s in far], comps[:20], comps[:20] >= 0, 80)
    assert not alone.any()


def test_texts_that_only_share_a_passage_are_not_copied(spark, monkeypatch):
    passage = words(60, 9)
    texts = [" ".join(passage + words(50, 100 + n)) for n in range(30)] + family(words(80, 4), 3, 5, 1)
    asked, whole = [], N._links

    def counted(part, *more):
        asked.append(part.count())
        return whole(part, *more)

    monkeypatch.setattr(N, "_links", counted)
    check(spark, list(enumerate(texts)))
    assert sum(asked) < 20  # the three of the family, a few times; met are 33


def test_the_pipeline_copies_texts_that_may_link(spark, monkeypatch):
    passage = words(60, 9)
    texts = [" ".join(passage + words(50, 300 + n)) for n in range(30)]
    near = words(80, 4)
    asked, whole = [], N._links

    def counted(part, *more):
        asked.append(part.count())
        return whole(part, *more)

    monkeypatch.setattr(N, "_links", counted)
    table = list(enumerate([*texts, " ".join(near), " ".join([*near, "x1"])]))
    kept = corpus_pipeline.near_copies(spark, docs(spark, table), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(31))
    assert sum(asked) < 10
