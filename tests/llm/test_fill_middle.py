import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.llm.frames import ODD, docs, rows, text
from tidemark.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, t):
    t = t or ""
    units = UNIT.findall(t)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def compare(spark, table, clash=False):
    made = M.transform(docs(spark, table, clash))
    got = [tuple(r) for r in made.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(got, key=key) == sorted((brute(r[0], r[1]) for r in table), key=key)
    back = rows(M.digests(made).select("doc_id", "restored_sha256"))
    assert sorted(r["restored_sha256"] for r in back) == sorted(sha(r[1] or "") for r in table)


TABLE = [
    *[(100 + i, text(i % 40, i) + ("  \n" if i % 3 == 0 else "")) for i in range(120)],
    *[(300 + i, f"a <{'PSM'[i % 3]}> b") for i in range(6)],
    *[(400 + i, "<P <S <M P> S> M> < << <P<S" + " <" * i) for i in range(30)],
    *[(500 + i, " \t lead x   y 😀z $1 \\ $2 \r\n\x0b\x0c end \n") for i in range(20)],
    *ODD,
    *[(i, None) for i in range(600, 610)],
    (100, text(5, 1)),
    (100, text(5, 1)),
]


@pytest.mark.parametrize("clash", [False, True])
def test_same_as_brute_force(spark, clash):
    compare(spark, TABLE, clash)


def test_very_long_texts_need_no_stack(spark):
    table = [(i, "ab " * 400_000 + "\n") for i in range(6)] + [(10 + i, "x" * 1_500_000) for i in range(4)]
    compare(spark, table)


def test_empty_table(spark):
    assert rows(M.digests(M.transform(docs(spark, [])))) == []


def test_shares_follow_the_parameters(spark):
    made = rows(M.transform(docs(spark, [(i, text(9, i)) for i in range(400)]), percent=100, spm_percent=0))
    assert {r["form"] for r in made} == {"psm"}
    forms = [r["form"] for r in rows(M.transform(docs(spark, [(i, text(9, i)) for i in range(1000)])))]
    assert 420 < forms.count("plain") < 580 and forms.count("spm") > 2 * forms.count("psm")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab <>PSM \t\n é😀$\\", max_size=40), min_size=1, max_size=30))
def test_round_trip_of_any_text(spark, texts):
    compare(spark, list(enumerate(texts)))
