from collections import Counter

from tests.llm.frames import ODD, docs, rows, split_words, text, words
from tidemark.llm import quality_rules as Q


def brute(t):
    w = split_words(t)
    lines = [x for x in (t or "").split("\n") if split_words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in t or ""),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_statistics(spark):
    table = [
        *ODD, (10, "a a a a a"), (11, "a b a b a b c"), (12, "x y z\nx y z\n\n x y z\n" + text(60, 1)), (13, "#*|𝄞 <é>\x0b&"),
        (14, text(40, 2) + "\n" + text(40, 2)), (15, (text(30, 3) + "\n") * 40), (15, (text(30, 3) + "\n") * 40), (16, text(9000, 4)),
    ]
    got = rows(Q.judge(docs(spark, table, clash=True)))
    assert len(got) == len(table)
    texts = {d: t for d, t in table}
    for r in got:
        want = brute(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    assert Q.judge(docs(spark, [])).count() == 0


def test_lines_of_a_host(spark):
    bar = " ".join(f"Menu{i}" for i in range(80)) + " 1234"
    own = [(i, bar.replace("1234", str(1000 + i)) + "\n" + text(30, i), "a") for i in range(30)]  # mostly furniture
    rich = [(100 + i, bar.upper() + "\n" + text(200, 50 + i), "a") for i in range(5)]
    other = [(200 + i, bar + "\n" + text(30, 90 + i), "b") for i in range(10)]  # too few on this host
    copies = [(300 + i, text(60, 7) + "\n" + text(60, 8) + f"\nodd{i} word here", "a") for i in range(40)]  # near copies
    nobody = [(400 + i, bar + "\n" + text(30, 300 + i), None) for i in range(25)]
    frame = docs(spark, [*own, *rich, *other, *copies, *nobody], clash=True)
    kept = {r["doc_id"]: r["kept"] for r in rows(Q.judge(frame))}
    want = {d: not (d < 100 or d >= 400) for d in kept}
    assert kept == want
    left = rows(Q.kept_rows(frame))
    assert {r["doc_id"] for r in left} == {d for d in want if want[d]}
    assert Q.kept_rows(frame).columns == frame.columns


def test_families_neither_saturate_nor_hold_the_line(spark):
    foot = " ".join(f"all rights reserved {k}" for k in "abcdefghijklmno")
    longest = foot + " https://an.example.org/a-very-long-address-that-no-other-word-reaches"
    own = [(i, text(40, i) + "\n" + longest, "url") for i in range(30)]  # the footer holds the longest word
    few = [(100 + i, " ".join(w[:5] for w in words(40, i)) + f" longestword{i % 5}\n" + foot, "few") for i in range(200)]
    menu = [f"entry {k} of the long menu of this host" for k in "abcdefgh"]  # furniture of many lines
    bars = [(400 + i, "\n".join([*menu, text(50, 400 + i)]), "bars") for i in range(60)]
    prose = [text(9, 900 + k) for k in range(20)]
    copies = []
    for i in range(60):  # near copies with an edited line
        mine = prose[:]
        mine[i % 20] = mine[i % 20].replace(" ", f" q{i} ", 1)
        copies.append((600 + i, "\n".join(mine), "copies"))
    kept = {r["doc_id"]: r["kept"] for r in rows(Q.judge(docs(spark, [*own, *few, *bars, *copies])))}
    assert kept == {d: d >= 600 for d in kept}


def test_kept_rows_are_without_furniture(spark):
    foot, own = "Contact  us 12", [f"{text(60, i)}\n\nContact us {10 + i}\n{text(9, 200 + i)}" for i in range(30)]
    table = [(i, t, "a") for i, t in enumerate(own)] + [(100, own[0], "b"), (101, text(70, 5) + "\n" + foot, "a")]
    left = {r["doc_id"]: r["text"] for r in rows(Q.kept_rows(docs(spark, table, clash=True)))}
    want = {i: f"{text(60, i)}\n\n{text(9, 200 + i)}" for i in range(30)}
    assert left == {**want, 100: own[0], 101: text(70, 5)}
