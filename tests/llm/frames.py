"""Small inputs shared by the operator tests."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Extra columns that clash with names the operators use inside.
CLASH = DOCS + ", size long, words string, target double, key long, row string, fp long, taken long, finding string"


def words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    parts = "ka lo mi ne ru sto ven pra dil qua zor bex fum gli".split()
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)]


def text(n: int, seed: int) -> str:
    return " ".join(words(n, seed))


def docs(spark, rows, clash=False):
    """Rows of (doc_id, text[, source]) as a documents table."""
    full = []
    for r in rows:
        doc_id, t = r[0], r[1]
        source = r[2] if len(r) > 2 else "s0"
        base = (doc_id, t, "en", source, len(t or ""))
        full.append((*base, -1, "w", -1.0, -2, "r", 5, 9, "f") if clash else base)
    return spark.createDataFrame(full, CLASH if clash else DOCS)


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "lo mi ne"), (4, "é" * 3000), (5, "one")]


def split_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def rows(df, *order):
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple((r[c] is None, r[c] if r[c] is not None else 0) for c in order)) if order else out
