import random
import zlib

import pytest

from tests.llm.frames import ODD, docs, rows, words
from tidemark.llm import toxicity as T

INSULTS = ["glorkhead", "snivelwit", "dungbrain", "mudwurm"]


def corpus(n, seed, spoil=None):
    r = random.Random(seed)
    table, labels = [], []
    for i in range(n):
        w = words(60, seed * 1000 + i)
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                x = r.choice(INSULTS)
                w.insert(r.randrange(len(w)), spoil(x, r) if spoil else x)
        sentences = [" ".join(w[k : k + 12]).capitalize() + "." for k in range(0, len(w), 12)]
        table.append((seed * 1000 + i, " ".join(sentences)))
        labels.append((seed * 1000 + i, int(bad)))
    return table, labels


def test_held_out_accuracy_and_variants(spark):
    table, labels = corpus(240, 1)
    odd = [*ODD, (7, "a" * 4000 + " glorkhead")]
    frame = docs(spark, [*odd, *table, table[0]], clash=True)
    lab = spark.createDataFrame(
        [(d, 1, t, "clash") for d, t in [*labels, (1, None), (None, 1)]], "doc_id long, quality int, toxic int, text string"
    )
    got = rows(T.score_documents(frame, lab))
    assert len(got) == len(table) + len(odd) + 1
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert len(held) > 30 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] in (1, 2, 3, 7)} == {1: 0, 2: 0, 3: 0, 7: 1}
    again = {r["doc_id"]: r["score"] for r in rows(T.score_documents(frame.repartition(7), lab))}
    assert again == {r["doc_id"]: r["score"] for r in got}


@pytest.mark.parametrize(
    "spoil",
    [
        lambda x, r: ".".join(x),
        lambda x, r: " ".join(x),
        lambda x, r: x.upper() + "!",
        lambda x, r: (lambda k: x[:k] + x[k] + x[k:])(r.randrange(2, len(x))),
    ],
)
def test_gapped_and_doubled_characters(spoil):
    table, labels = corpus(240, 1)
    model = T.train([(t, y) for (_, t), (_, y) in zip(table, labels)])
    fresh, truth = corpus(60, 2, spoil)
    right = 0
    for (_, t), (_, y) in zip(fresh, truth):
        top = max(model.margins([x for s in T._SENTENCE.split(t) for x in T.terms(s)]))
        right += (model.score(top) >= 0.5) == y
    assert right >= 54


def test_kernel_against_its_definition():
    from itertools import combinations

    def phi(w):
        out = {}
        for at in combinations(range(len(w)), T.ORDER):
            if at[-1] - at[0] < T.SPAN:
                u = tuple(w[i] for i in at)
                out[u] = out.get(u, 0) + T.DECAY ** (at[-1] - at[0] + 1)
        return out

    def dot(a, b):
        return sum(v * b.get(u, 0) for u, v in a.items())

    some = ["banana", "bandana", "ananas", "glorkhead", "xyz", "abcd", "aaaaaaaaaaaa"]
    marks = T.Landmarks(["banana", "glorkhead", "aaaaa"], "bandglorkhe")
    k = marks.kernel(some)
    for i, w in enumerate(some):
        for j, m in enumerate(marks.words):
            a, b = phi(w), phi(m)
            want = dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5 if a else 0.0
            assert k[i, j] == pytest.approx(want, abs=1e-6)


def test_no_labels_and_empty(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in rows(T.score_documents(docs(spark, [(1, "x y")]), lab))] == [0.0]
    assert T.score_documents(docs(spark, []), lab).count() == 0


def test_insults_of_a_second_script():
    signs = ["".join(chr(0x4E00 + 13 * k + j) for j in range(8)) for k in range(12)]
    table, labels = corpus(240, 1, lambda x, r: r.choice(INSULTS + signs))
    model = T.train([(t, y) for (_, t), (_, y) in zip(table, labels)])
    for w in INSULTS + signs:
        assert model.score(max(model.margins(T.terms(w)))) >= 0.5, w
