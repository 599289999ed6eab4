"""License scan: ordered signature rules behind a keyword prefilter.

Native expressions in one pass over the rows: no join, no shuffle, no Python.  A text is
reduced to its words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) with single
spaces between.  Only texts holding one of the rules' keywords go further; for these every
rule whose keyword is present is matched, and a match is

* suppressed when a match of higher or equal priority contains it (equal intervals: the
  earlier rule stays), so "gnu lesser general public license v2 1" is not reported as the
  plain phrase inside it as well;
* kept otherwise, with its label, first word and number of words.

The base phrases are reported besides, wherever their words stand.  Null and blank texts
have no words, no label and score 0.  Rows are judged one by one: repeated rows alike.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower

BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases that every scan reports, with their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# License families: label, keyword, pattern of the name, pattern of a version.
FAMILIES = [
    ("apache", "apache", "apache(?: software)? licen[sc]e", "(?:version |v)?(?:1 0|1 1|2 0|2)"),
    ("mit", "mit", "(?:the )?mit (?:x11 )?licen[sc]e", ""),
    ("gpl", "general", "(?:gnu )?general public licen[sc]e", "(?:version |v)?[123](?: 0)?(?: or later| only)?"),
    ("lgpl", "lesser", "(?:gnu )?lesser general public licen[sc]e", "(?:version |v)?(?:2 1|3 0|2|3)(?: or later| only)?"),
    ("lgpl", "library", "(?:gnu )?library general public licen[sc]e", "(?:version |v)?2(?: 0)?"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", "(?:version |v)?[13](?: 0)?(?: or later| only)?"),
    ("gpl", "gpl", "(?:gnu )?gpl", "(?:version |v)?[123](?: 0)?(?: or later| only)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", "(?:version |v)?(?:2 1|3 0|2|3)(?: or later| only)?"),
    ("agpl", "agpl", "(?:gnu )?agpl", "(?:version |v)?3(?: 0)?(?: or later| only)?"),
    ("mpl", "mozilla", "mozilla public licen[sc]e", "(?:version |v)?(?:1 0|1 1|2 0)"),
    ("mpl", "mpl", "mpl", "(?:version |v)?(?:1 1|2 0)"),
    ("epl", "eclipse", "eclipse public licen[sc]e", "(?:version |v)?[12] 0"),
    ("edl", "eclipse", "eclipse distribution licen[sc]e", "(?:version |v)?1 0"),
    ("cddl", "cddl", "cddl", "(?:version |v)?1 [01]"),
    ("cddl", "distribution", "common development and distribution licen[sc]e", "(?:version |v)?1 [01]"),
    ("bsd", "bsd", "bsd licen[sc]e", ""),
    ("bsd-2", "bsd", "(?:2|two) clause bsd", "licen[sc]e"),
    ("bsd-3", "bsd", "(?:3|three) clause bsd", "licen[sc]e"),
    ("bsd-4", "bsd", "(?:4|four) clause bsd", "licen[sc]e"),
    ("0bsd", "0bsd", "0bsd", "licen[sc]e"),
    ("isc", "isc", "isc licen[sc]e", ""),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e", ""),
    ("boost", "boost", "boost software licen[sc]e", "(?:version |v)?1 0"),
    ("artistic", "artistic", "artistic licen[sc]e", "(?:version |v)?[12] 0"),
    ("python", "python", "python software foundation licen[sc]e", "(?:version |v)?2"),
    ("unlicense", "unlicense", "the unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", "(?:version |v)?2"),
    ("eupl", "european", "european union public licen[sc]e", "(?:version |v)?1 [12]"),
    ("osl", "open", "open software licen[sc]e", "(?:version |v)?[123] 0"),
    ("ofl", "font", "(?:sil )?open font licen[sc]e", "(?:version |v)?1 [01]"),
    ("odbl", "database", "open database licen[sc]e", "(?:version |v)?1 0"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[sc]e", "(?:version |v)?1 [123]"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e", ""),
    ("openssl", "openssl", "openssl licen[sc]e", ""),
    ("php", "php", "php licen[sc]e", "(?:version |v)?3 0[01]"),
    ("ruby", "ruby", "ruby licen[sc]e", ""),
    ("cc0", "cc0", "cc0", "1 0(?: universal)?"),
    ("cc-by", "cc", "cc by", "[1234] 0"),
    ("cc-by-sa", "cc", "cc by sa", "[1234] 0"),
    ("cc-by-nc", "cc", "cc by nc", "[1234] 0"),
    ("cc-by-nd", "cc", "cc by nd", "[1234] 0"),
    ("cc-by-nc-sa", "cc", "cc by nc sa", "[1234] 0"),
    ("cc-by-nc-nd", "cc", "cc by nc nd", "[1234] 0"),
    ("cc-by", "creative", "creative commons attribution(?: licen[sc]e)?", "[1234] 0"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike", "[1234] 0"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial", "[1234] 0"),
    ("proprietary", "rights", "all rights reserved", ""),
    ("public-domain", "domain", "(?:released into|dedicated to|in) the public domain", ""),
]
# Phrases that lead to a license name, and their strength.
LEADS = [
    ("(?:this \\w+ |this )?(?:is |are )?licensed under(?: the)?(?: terms of)?(?: the)?", 1.0),
    ("(?:is |are )?(?:released|distributed|published|available) under(?: the)?(?: terms of)?(?: the)?", 1.0),
    ("spdx license identifier", 1.0),
    ("under the terms of(?: the)?", 0.95),
    ("subject to(?: the)?(?: terms of)?(?: the)?", 0.9),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def signature_rules() -> list[Rule]:
    """All rules in order: lead, name and version; lead and name; name and version; name."""
    levels: list[list[Rule]] = [[], [], [], []]
    for label, keyword, name, version in FAMILIES:
        for lead, weight in LEADS:
            if version:
                levels[0].append(Rule(label, keyword, f"{lead} {name} {version}", 1, weight))
            levels[1].append(Rule(label, keyword, f"{lead} {name}", 2, weight * 0.95))
        if version:
            levels[2].append(Rule(label, keyword, f"{name} {version}", 3, 0.85))
        levels[3].append(Rule(label, keyword, name, 4, 0.7))
    return [r for level in levels for r in level]


def _starts(text: Column, pattern: Column) -> Column:
    """(begin, end) of every match of ``pattern`` standing on word borders in ``text``."""
    full = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    hits = F.regexp_extract_all(text, full, F.lit(0))
    gaps = F.split(text, full, -1)
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    none = F.array().cast("array<struct<begin:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        one = F.struct(begin.cast("int").alias("begin"), (begin + x["h"]).cast("int").alias("end"))
        return F.struct((begin + x["h"]).cast("int").alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("all")), step, lambda acc: acc["all"])


def _phrase_places(words: Column, phrase: str) -> Column:
    """Word positions (from 0) at which the phrase's words stand one after the other."""
    parts = phrase.split()

    def here(_: Column, i: Column) -> Column:
        same = [F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(parts)]
        out = same[0]
        for s in same[1:]:
            out = out & s
        return out

    spots = F.transform(words, lambda w, i: i)
    return F.filter(spots, lambda s: here(s, s))


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``detections`` lists the kept matches: label, first_word, n_words, priority, weight.
    ``score`` is the largest weight of a kept match (0.7 at least for a base phrase).
    """
    rules = signature_rules() if rules is None else rules
    keywords = sorted({r.keyword for r in rules} | {p.split()[-1] for p, _ in BASE})
    kind = "array<struct<id:int,label:string,keyword:string,pattern:string,priority:int,weight:double>>"
    table = F.from_json(F.lit(json.dumps([asdict(r) | {"id": i} for i, r in enumerate(rules)])), kind)

    text = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), BREAK, " "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(" "), text, F.lit(" ")).alias("norm"))
    count = F.when(F.col("norm") == "  ", F.lit(0)).otherwise(
        F.length("norm") - F.length(F.translate("norm", " ", "")) - 1
    )
    rows = rows.select("doc_id", count.cast("long").alias("n_words"), "norm")
    gate = F.lit(False)
    for k in keywords:
        gate = gate | F.contains("norm", F.lit(f" {k} "))
    norm = F.col("norm")

    def of_rule(r: Column) -> Column:
        return F.transform(
            _starts(norm, r["pattern"]),
            lambda x: F.struct(
                r["id"].alias("id"), r["label"].alias("label"), r["priority"].alias("priority"),
                r["weight"].alias("weight"), x["begin"].alias("begin"), x["end"].alias("end"),
            ),
        )

    asked = F.filter(table, lambda r: F.contains(norm, F.concat(F.lit(" "), r["keyword"], F.lit(" "))))
    empty = F.array().cast("array<struct<id:int,label:string,priority:int,weight:double,begin:int,end:int>>")
    found = F.when(gate, F.flatten(F.transform(asked, of_rule))).otherwise(empty)
    words = F.when(gate, F.split(F.btrim(norm), " ")).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", "n_words", "norm", found.alias("found"), words.alias("words"))

    def within(x: Column, y: Column) -> Column:
        inside = (y["begin"] <= x["begin"]) & (y["end"] >= x["end"])
        equal = (y["begin"] == x["begin"]) & (y["end"] == x["end"])
        stronger = (y["priority"] < x["priority"]) | ((y["priority"] == x["priority"]) & (~equal | (y["id"] < x["id"])))
        return inside & (y["id"] != x["id"]) & stronger

    kept = F.filter("found", lambda x: ~F.exists("found", lambda y: within(x, y)))
    rows = rows.select(
        "doc_id", "n_words", "norm", "words", kept.alias("kept"),
        *[_phrase_places(F.col("words"), p).alias(f"p{i}") for i, (p, _) in enumerate(BASE)],
    )
    places = F.concat(*[F.col(f"p{i}") for i in range(len(BASE))])
    base = F.array_compact(
        F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(BASE)])
    )
    labels = F.array_union(base, F.transform("kept", lambda x: x["label"]))
    weights = F.transform("kept", lambda x: x["weight"])
    score = F.greatest(
        F.coalesce(F.array_max(weights), F.lit(0.0)), F.when(F.size(places) > 0, F.lit(0.7)).otherwise(F.lit(0.0))
    )

    def spaces(part: Column) -> Column:
        return F.length(part) - F.length(F.translate(part, " ", ""))

    shown = F.transform(
        "kept",
        lambda x: F.struct(
            x["label"].alias("label"),
            (spaces(F.substring(norm, F.lit(1), x["begin"])) - 1).alias("first_word"),
            (spaces(F.substring(norm, x["begin"] + 1, x["end"] - x["begin"])) + 1).alias("n_words"),
            x["priority"].alias("priority"),
            x["weight"].alias("weight"),
        ),
    )
    return rows.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(labels)), ",").alias("labels"),
        score.alias("score"),
        shown.alias("detections"),
    )
