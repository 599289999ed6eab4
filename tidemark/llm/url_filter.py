"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

A URL's canonical form is ``.host/path``: the host (after the first ``://`` up to ``/``,
``?``, ``#`` or the end) with A-Z lower-cased, then the path up to ``?``, ``#`` or the end.
Rules are globs over it: ``?`` is one character, ``*`` any run within the host or within one
path segment (no ``/``), ``**`` any run.  All globs are packed one after the other into a
row of 64-bit words (Shift-And): a glob takes a start bit and one bit per symbol, a run
wildcard is a self-loop on the bit before it.  One step per character moves every glob of
every URL of a batch at once.

Null URLs and those without ``://`` have an empty host and path; the default verdict
applies unless a glob matches the bare ``.``.  Repeated rows are judged alike, extra
columns of the input are not looked at, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower

ONE = np.uint64(1)
BATCH = 4096

# The rules that every crawl is judged by (verdict, host, path).
BASE_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
# Further globs, which decide where no rule above fits.
GLOBS = [
    ("block", "*casino*/**"),
    ("block", "*bets*/**"),
    ("block", "*poker*/**"),
    ("block", "*jackpot*/**"),
    ("block", "**/wp-login*"),
    ("block", "**/cgi-bin/**"),
    ("block", "**.exe"),
    ("block", "**.zip"),
    ("block", "**/tag/?*/page/**"),
]


@dataclass(frozen=True)
class Automaton:
    """Masks of all globs; its size follows the rule set only."""

    alphabet: np.ndarray  # sorted code points that some glob names
    symbol: np.ndarray  # per character class: bits that may be entered
    loop: np.ndarray  # bits kept on any character
    loop_inside: np.ndarray  # bits kept on any character but "/"
    start: np.ndarray
    final: list[tuple[int, int]]  # word and bit of each glob's last symbol
    slash: int


def compile_globs(globs: list[str]) -> Automaton:
    """Pack ``globs`` into Shift-And masks."""
    alphabet = np.array(sorted({ord(c) for g in globs for c in g if c not in "*?"} | {ord("/")}), np.uint32)
    place = {int(c): i + 1 for i, c in enumerate(alphabet)}
    bits: list[tuple[str, bool, bool]] = []  # symbol ("" start), loops, loops inside
    ends = []
    for g in globs:
        own: list[list] = [["", False, False]]
        i = 0
        while i < len(g):
            if g[i] == "*":
                run = len(g) - i - len(g[i:].lstrip("*"))
                own[-1][1 if run > 1 else 2] = True
                i += run
            else:
                own.append([g[i], False, False])
                i += 1
        bits += [tuple(x) for x in own]
        ends.append(len(bits) - 1)
    n = max(1, -(-len(bits) // 64))
    symbol = np.zeros((len(alphabet) + 1, n), np.uint64)
    loop, inside, start = (np.zeros(n, np.uint64) for _ in range(3))
    for b, (c, any_, within) in enumerate(bits):
        w, bit = divmod(b, 64)
        v = np.uint64(1 << bit)
        if c == "":
            start[w] |= v
        elif c == "?":
            symbol[:, w] |= v
        else:
            symbol[place[ord(c)], w] |= v
        loop[w] |= v if any_ else np.uint64(0)
        inside[w] |= v if within else np.uint64(0)
    return Automaton(alphabet, symbol, loop, inside, start, [divmod(e, 64) for e in ends], place[ord("/")])


def run_automaton(a: Automaton, urls: list[str]) -> np.ndarray:
    """Boolean matrix: which glob (column) matches the whole of which URL (row)."""
    out = np.zeros((len(urls), len(a.final)), bool)
    order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
    for lo in range(0, len(order), BATCH):
        rows = order[lo : lo + BATCH]
        sizes = np.array([len(urls[i]) for i in rows])
        state = np.tile(a.start, (len(rows), 1))
        longest = int(sizes[0]) if len(rows) else 0
        # Characters of all rows back to back; row r's character p is at begin[r] + p.
        text = np.frombuffer("".join(urls[i] for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(a.alphabet, text)
        known = a.alphabet[np.minimum(at, len(a.alphabet) - 1)] == text
        kind = np.where(known, at + 1, 0)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        live = len(rows)
        for p in range(longest):
            while live and sizes[live - 1] <= p:
                live -= 1
            d = state[:live]
            c = kind[begin[:live] + p]
            moved = d << ONE
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            kept = d & (a.loop | np.where((c == a.slash)[:, None], np.uint64(0), a.loop_inside))
            state[:live] = (moved & a.symbol[c]) | kept
        for r, (w, bit) in enumerate(a.final):
            out[rows, r] = (state[:, w] >> np.uint64(bit)) & ONE
    return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for a null or one without ``://``."""
    some = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, "(?s)^.*?://", "")
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(some, host).otherwise(F.lit("")), F.when(some, path).otherwise(F.lit(""))


def judge_urls(
    pages: DataFrame,
    base: list[tuple[str, str, str]] = BASE_RULES,
    globs: list[tuple[str, str]] = GLOBS,
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict, glob of every page.

    ``base`` rules fit a host and its subdomains where the path begins with theirs; the
    longest wins (equal lengths: block first, then by text).  Where none fits, the first
    fitting glob decides, else ``default``.  ``rule`` and ``glob`` say which did.
    """
    ranked = sorted(base, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    patterns = ["*." + h.lower() + p + "**" for _, h, p in ranked]
    patterns += [g for _, g in globs]
    if any(set("*?") & set(h + p) for _, h, p in base):
        raise ValueError("base rules are literal; give wildcards as globs")
    machine = compile_globs(patterns)
    n = len(ranked)
    names = [h + p for _, h, p in ranked]
    verdicts = [v for v, _, _ in ranked] + [v for v, _ in globs]
    glob_names = [g for _, g in globs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = ["." + h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            got = run_automaton(machine, urls)
            by_rule = got[:, :n].any(axis=1)
            by_glob = got[:, n:].any(axis=1)
            first = np.where(by_rule, got[:, :n].argmax(axis=1) if n else 0, n + (got[:, n:].argmax(axis=1) if globs else 0))
            made = [
                [names[f] if r else None for r, f in zip(by_rule, first)],
                [verdicts[f] if r or g else default for r, g, f in zip(by_rule, by_glob, first)],
                [glob_names[f - n] if g and not r else None for r, g, f in zip(by_rule, by_glob, first)],
            ]
            # Ids, hosts and paths are handed on as they came.
            columns = [*batch.columns, *[pa.array(m, pa.string()) for m in made]]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict", "glob"])

    host, path = url_parts(F.col("url").cast("string"))
    return pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).mapInArrow(
        run, "page_id long, host string, path string, rule string, verdict string, glob string"
    )
