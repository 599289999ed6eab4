import hashlib
import random

from tests.llm.frames import ODD, docs, rows, text
from tidemark.llm import secret_scan as S


def corpus(n, seed=1):
    r = random.Random(seed)
    table, truth = [], {}
    for i in range(n):
        h = hashlib.sha1(f"{seed}{i}".encode()).hexdigest()
        kind = i % 4
        if kind == 0:
            t, secret = f'{text(20, i)} token = "{h}" {text(9, i)}', h
        elif kind == 1:
            t, secret = f'{text(20, i)} {r.randrange(10**15, 10**16)} {text(9, i)}', None
        elif kind == 2:
            t, secret = f'{text(9, i)} see /var/log/app{i}/file-name-{i}.txt and {text(9, i)}', None
        else:
            t, secret = f'{text(9, i)} password: "{h[:24]}"\n{text(9, i)}', h[:24]
        table.append((1000 + i, t))
        truth[1000 + i] = secret
    return table, truth


def test_held_out_findings(spark):
    table, truth = corpus(200)
    fresh, fresh_truth = corpus(80, seed=9)
    labelled = S.labelled_findings(docs(spark, table))
    got = rows(S.scan(docs(spark, [*ODD, *fresh, fresh[0]], clash=True), labelled))
    assert all(0 <= r["score"] <= 1 and r["secret"] == (r["score"] >= 0.5) for r in got)
    right = sum(r["secret"] == (fresh_truth[r["doc_id"]] == r["value"]) for r in got)
    assert right / len(got) > 0.95
    assert {r["doc_id"] for r in got if r["secret"]} >= {d for d, s in fresh_truth.items() if s}
    same = [r for r in got if r["doc_id"] == fresh[0][0]]
    assert len(same) == 2 and same[0] == same[1]


def test_redaction_keeps_rows_and_clean_texts(spark):
    table, truth = corpus(80)
    frame = docs(spark, [*ODD, *table], clash=True)
    out = S.redact(frame)
    assert out.columns == frame.columns
    before = {r["doc_id"]: r["text"] for r in rows(frame)}
    for r in rows(out):
        secret = truth.get(r["doc_id"])
        assert r["text"] == (before[r["doc_id"]].replace(secret, "[secret]") if secret else before[r["doc_id"]])


def test_no_labels_and_empty(spark):
    assert S.scan(docs(spark, [])).count() == 0
    one = docs(spark, [(1, f"{text(9, 1)} 1234567890123456 {text(3, 2)}")])
    (r,) = rows(S.scan(one))
    assert (r["value"], r["secret"], r["at"]) == ("1234567890123456", False, 9)


def test_every_secret_of_a_word(spark):
    table, _ = corpus(160)
    a, b, c, d = (hashlib.sha1(x.encode()).hexdigest() for x in "abcd")
    aws = "AKIA" + "Q7" * 8
    cases = [
        (1, f"AWS_SECRET_ACCESS_KEY={a}", [a]),
        (2, f"https://service-host-name.example.org/cb?token={a}&secret={b}", [a, b]),
        (3, '{"token":"%s","password":"%s"}' % (a, b), [a, b]),
        (4, f"{aws},secret={c}", [aws, c]),
        (5, f"{aws}:{'ghp_' + 'aB3' * 12}", [aws, "ghp_" + "aB3" * 12]),
        (6, f"secret={a[:32]}==,token={d}", [a[:32] + "==", d]),
        (7, f'token="{a}"\nsecret={a + b}', [a, a + b]),  # one value begins with the other
    ]
    known = [(5000 + i, f"{text(9, i)} SECRET_KEY={hashlib.sha1(str(i).encode()).hexdigest()} {text(9, i)}") for i in range(60)]
    frame = docs(spark, [*table, *known, *[(i, f"{text(9, i)} {w} {text(9, i)}") for i, w, _ in cases]])
    got = rows(S.scan(frame))
    clean = {r["doc_id"]: r["text"] for r in rows(S.redact(frame))}
    for i, w, secrets in cases:
        assert sorted(r["value"] for r in got if r["doc_id"] == i and r["secret"]) == sorted(secrets), w
        want = f"{text(9, i)} {w} {text(9, i)}"
        for s in sorted(secrets, key=len, reverse=True):
            want = want.replace(s, "[secret]")
        assert clean[i] == want
