import random
import re

from tests.llm.frames import rows
from tidemark.llm.url_filter import BASE_RULES, compile_globs, judge_urls, run_automaton

SCHEMA = "page_id long, url string, html string, host string, rule string"


def as_pattern(glob):
    out, i = "", 0
    while i < len(glob):
        if glob[i] == "*":
            run = len(glob[i:]) - len(glob[i:].lstrip("*"))
            out += ".*" if run > 1 else "[^/]*"
            i += run
        else:
            out += "." if glob[i] == "?" else re.escape(glob[i])
            i += 1
    return re.compile(out, re.S)


def test_automaton_is_the_same_as_regular_expressions():
    r = random.Random(3)
    globs = ["".join(r.choice("ab/*?") for _ in range(r.randint(1, 9))) for _ in range(60)] + ["é*", "**a?b**", "*" * 2]
    urls = ["".join(r.choice("ab/é") for _ in range(r.randint(0, 14))) for _ in range(300)]
    got = run_automaton(compile_globs(globs), urls)
    for j, g in enumerate(globs):
        p = as_pattern(g)
        for i, u in enumerate(urls):
            assert got[i, j] == bool(p.fullmatch(u)), (g, u)


def brute(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = re.sub("[A-Z]", lambda m: m.group().lower(), rest[:cut]), rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return host, tail[:end]


def test_rules_and_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http:///es/", "HTTP://A.Example.ORG/es/x?y", "x://example.org/en/1234",
        "x://example.org/en/2", "x://notexample.org/es/", "x://a.com/FR/", "x://com/fr/", "x://b.com/de/#q", "x://b.com?/de/",
        "x://casino-x.net/a", "x://a.net/get.exe", "x://a.net/://b", "x://a.net\nb/c", "x://" + "a" * 5000 + ".org/" + "b" * 5000,
    ]
    frame = spark.createDataFrame([(i, u, "", "clash", "clash") for i, u in enumerate(urls)] + [(0, None, "", "c", "c")], SCHEMA)
    got = rows(judge_urls(frame), "page_id")
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = brute(urls[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        fits = [(h + p, v) for v, h, p in BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits, key=lambda f: len(f[0])) if fits else (None, None)
        assert r["rule"] == want[0]
        if fits:
            assert r["verdict"] == want[1]
        else:
            assert r["verdict"] == ("block" if "casino" in host or path.endswith(".exe") else "allow")
    assert judge_urls(frame.limit(0)).count() == 0


def test_large_and_null_ids_stay_as_they_are(spark):
    ids = [2**60 + 1, None, 2**63 - 1, -5, None]
    frame = spark.createDataFrame([(i, "x://a.org/", "", "c", "c") for i in ids], SCHEMA).coalesce(1)
    assert sorted(str(r["page_id"]) for r in rows(judge_urls(frame))) == sorted(map(str, ids))
