"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks.

A text is read as sentences, a sentence as *terms*: its words, A-Z lower-cased, without ASCII
punctuation and with a mark at both ends (runs of single characters, "i d i o t", are one
term; very long terms are taken in overlapping pieces).  Two terms are compared by the gap-weighted
subsequence kernel: common subsequences of ``ORDER`` characters within ``SPAN``, each gap
costing a factor ``DECAY``, normalised; inserted or left-out characters lower it only a
little.

Training (on the driver, on a bounded sample of labelled texts, ``MAX_TEXTS`` per class and
by hash): landmarks are the terms most typical for toxic texts, by the difference of their
document shares, with frequent other terms as contrast.  The kernel values to the landmarks,
whitened by the landmarks' own kernel matrix (Nyström), are a term's features; a sentence
stands by its strongest terms.  A linear SVM is fitted on the labelled sentences; as labels
are per text, the positive sentences of a toxic text are chosen anew in every round as those
with a margin above 0 (multiple-instance SVM).  A text's score is a logistic curve of its
sentences' largest margin, 0.5 at the cutoff that serves the training texts best.

Scoring is one narrow pass.  The decision is linear in the kernel, so it folds into one
weight per subsequence, exactly; terms repeat, so each task scores a term once and remembers
it in a bounded memo.  Null and empty texts have no terms and get the score of the bias.
With no labelled texts of both classes every score is 0.  Repeated rows score alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UPPER

MAX_TEXTS = 1500  # labelled texts per class that training looks at
LANDMARKS = 256
ORDER = 4
DECAY = 0.8
DENSE = 50**4  # subsequences of the landmarks' characters that a table may have; else only those in landmarks are numbered
RATIO = 4.0  # a positive term's share of toxic texts over its share of clean ones, at least
TYPICAL = 2.5  # deviations from which a term makes a toxic text's sentence positive at first
SPAN = 8  # longest stretch of a term that one subsequence may lie in
PIECE = 24  # longest stretch of a term that the kernel looks at at once
MEMO = 400_000  # words a task remembers at most; then it starts anew
PART_CHARS = 2_000_000  # texts scored together
ROUNDS = 3
RIDGE = 1e-4
HIGHEST_CUT = 0.9  # the SVM puts typical terms at 1: the cutoff stays below, for variants
CLEAN_COST = 3.0  # a clean text called toxic weighs so many times a toxic one that is missed

_LOWER = str.maketrans(UPPER, UPPER.lower())
_MARKS = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
HEAD, TAIL = "\x02", "\x03"  # borders of a term, characters of the kernel like others
_SPELLED = re.compile(r"(?:(?<=\s)|^)(?:\S[^\w\s]?\s+){2,}\S[^\w\s]?(?=\s|$)")
_SENTENCE = re.compile(r"[.!?\n]+[ \t\r\n\f\v]+|\n+")


def terms(sentence: str) -> list[str]:
    """Terms of one sentence, in order."""
    out: list[str] = []
    single: list[str] = []
    for w in sentence.translate(_LOWER).split():
        w = w.translate(_MARKS)
        if len(w) == 1:
            single.append(w)
            continue
        if len(single) > 2:
            out.append("".join(single))
        single = []
        if w:
            out.append(w)
    if len(single) > 2:
        out.append("".join(single))
    return [HEAD + w + TAIL for w in out]


def stretches(term: str) -> list[str]:
    if len(term) <= PIECE:
        return [term]
    half = PIECE // 2
    return [term[i : i + PIECE] for i in range(0, len(term) - half, half)]


_SPOTS: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # per length, which PIECE bounds


def _spots(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the subsequences of a term of length ``n``, and their weights.

    The weights' squares sum to 1, the norm of a term whose subsequences all differ.
    """
    if n in _SPOTS:
        return _SPOTS[n]
    at = np.array(
        [(i, i + 1 + j, *[i + 1 + k for k in rest]) for i in range(n) for j, *rest in combinations(range(min(SPAN, n - i) - 1), ORDER - 1)],
        np.int32,
    ).reshape(-1, ORDER)
    weight = DECAY ** (at[:, -1] - at[:, 0] + 1.0)
    _SPOTS[n] = at, (weight / np.sqrt((weight**2).sum())).astype(np.float32)
    return _SPOTS[n]


def excess(words: list[str]) -> np.ndarray:
    """Norm of each word (all of one length) over that of a word without repeats, 1 or more."""
    n = len(words[0])
    x = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).astype(np.uint64)
    spots, weight = _spots(n)
    code = np.zeros((len(words), len(spots)), np.uint64)
    for k in range(ORDER):
        code = code * np.uint64(0x9E3779B97F4A7C15) + x[:, spots[:, k]]
    order = np.argsort(code, axis=1)
    code = np.take_along_axis(code, order, 1)
    new = np.ones(code.shape, bool)
    new[:, 1:] = code[:, 1:] != code[:, :-1]
    group = np.cumsum(new.ravel()) - 1
    sums = np.bincount(group, weights=weight[order].ravel().astype(float))
    row = np.repeat(np.arange(len(words)), new.sum(axis=1))
    return np.sqrt(np.bincount(row, weights=sums**2, minlength=len(words)))


class Alphabet:
    """Numbers for the subsequences of the landmarks' characters; 0 is any other."""

    def __init__(self, letters: str) -> None:
        self.letters = letters
        self.size = len(letters) + 1
        points = np.array([ord(c) for c in letters], np.uint32)
        self.order = np.argsort(points)
        self.points = points[self.order]
        self.dense = self.size**ORDER <= DENSE
        self.used: np.ndarray | None = None  # sorted codes that have a number, if not all have

    @property
    def count(self) -> int:
        return self.size**ORDER if self.used is None else len(self.used) + 1

    def number(self, words: list[str]) -> None:
        """Number only the subsequences of ``words`` where a table of all would be too large."""
        if not self.dense:
            found = [np.unique(self.subsequences([words[i] for i in rows])) for rows in by_length(words, 256)]
            self.used = np.setdiff1d(np.concatenate(found), [0])

    def subsequences(self, words: list[str]) -> np.ndarray:
        """Number of each subsequence of each word (all of one length)."""
        n = len(words[0])
        x = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        at = np.minimum(np.searchsorted(self.points, x), len(self.points) - 1)
        code = np.where(self.points[at] == x, self.order[at] + 1, 0)
        code = code.astype(np.int32 if self.dense else np.int64)
        spots, _ = _spots(n)
        out = code[:, spots[:, 0]]
        other = out == 0
        for k in range(1, ORDER):
            part = code[:, spots[:, k]]
            other |= part == 0
            out = out * self.size + part
        out[other] = 0
        if self.used is None:
            return out
        if not len(self.used):
            return np.zeros_like(out)
        at = np.minimum(np.searchsorted(self.used, out), len(self.used) - 1)
        return np.where(self.used[at] == out, at + 1, 0)


def by_length(words: list[str], step: int) -> Iterator[list[int]]:
    """Positions of the words that have subsequences, in bounded groups of one length."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, rows in groups.items():
        if n >= ORDER:
            for lo in range(0, len(rows), step):
                yield rows[lo : lo + step]


class Landmarks:
    """The landmarks' part of the kernel: subsequence -> its weight in each landmark."""

    def __init__(self, words: list[str], letters: str) -> None:
        self.words = words
        self.alphabet = Alphabet(letters)
        self.alphabet.number(words)
        codes, column, weight = [], [], []
        for rows in by_length(words, 256):
            sub = self.alphabet.subsequences([words[i] for i in rows])
            codes.append(sub.ravel())
            column.append(np.repeat(rows, sub.shape[1]))
            part = [words[i] for i in rows]
            weight.append((_spots(len(part[0]))[1] / excess(part)[:, None]).ravel())
        all_codes = np.concatenate(codes)
        used, row = np.unique(all_codes, return_inverse=True)
        self.place = np.zeros(self.alphabet.count, np.int32)  # 0: in no landmark
        self.place[used] = np.arange(1, len(used) + 1)
        self.place[0] = 0
        table = np.zeros((len(used) + 1, len(words)))
        np.add.at(table, (row + 1, np.concatenate(column)), np.concatenate(weight))
        table[0] = 0
        if used[0] == 0:
            table[1] = 0
        self.table = table

    def kernel(self, words: list[str]) -> np.ndarray:
        """Normalised kernel of each word with each landmark; zeros for shorter words."""
        out = np.zeros((len(words), len(self.words)))
        for rows in by_length(words, 64):
            part = [words[i] for i in rows]
            _, weight = _spots(len(part[0]))
            for i, spots, r in zip(rows, self.place[self.alphabet.subsequences(part)], excess(part)):
                hit = spots > 0
                out[i] = weight[hit] @ self.table[spots[hit]] / r
        return out


@dataclass
class Model:
    """A fitted SVM: the weight of every subsequence, a bias and a logistic curve.

    The decision is linear in the kernel values, and these in the subsequences, so the
    landmarks, the whitening and the weights fold into one number per subsequence.
    """

    alphabet: Alphabet
    folded: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def pieces(self, words: list[str]) -> np.ndarray:
        """Margins of stretches without the bias.

        Repeated subsequences only lower a value: those of 0 or less are left as they are.
        """
        out = np.zeros(len(words))
        for rows in by_length(words, 512):
            part = [words[i] for i in rows]
            weighed = self.folded[self.alphabet.subsequences(part)] * _spots(len(part[0]))[1]
            value = weighed.sum(axis=1, dtype=np.float64)  # row by row: the same in any batch
            above = np.flatnonzero(value > 0)
            if len(above):
                value[above] /= excess([part[i] for i in above])
            out[rows] = value
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        flat = [(i, p) for i, w in enumerate(words) for p in stretches(w)]
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, np.array([i for i, _ in flat], np.int64), self.pieces([p for _, p in flat]))
        return out + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60))))


def _svm(x: np.ndarray, y: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear SVM (squared hinge, balanced classes, weighted rows) by Newton steps."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    cost = often * np.where(y > 0, 0.5 / often[y > 0].sum(), 0.5 / max(1, often[y < 0].sum()))
    ridge = RIDGE * np.eye(len(w))
    ridge[-1, -1] = 1e-8
    for _ in range(60):
        active = y * (xb @ w) < 1
        xa, ca = xb[active], cost[active]
        new = np.linalg.solve(ridge + (xa * ca[:, None]).T @ xa, (xa * ca[:, None]).T @ y[active])
        if np.abs(new - w).max() <= 1e-6:
            break
        w = 0.5 * (w + new)
    return w[:-1], float(w[-1])


def train(texts: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Model | None:
    """Fit on (text, 0 or 1); None without texts of both classes."""
    docs = [([t for s in _SENTENCE.split(text or "") if (t := terms(s))], y) for text, y in texts]
    n = Counter(y for _, y in docs)
    if not n[0] or not n[1]:
        return None
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for sents, y in docs:
        seen[y].update({p for s in sents for t in s for p in stretches(t) if len(p) >= ORDER})

    def typical(p: str) -> float:
        """How many deviations the toxic share of texts with ``p`` lies above the clean one."""
        a, b = seen[1][p] / n[1], (seen[0][p] + 0.5) / (n[0] + 1)
        if a < RATIO * b:
            return 0.0  # common in clean texts too
        return (a - b) / np.sqrt(a / n[1] + b / n[0] + 1e-9)

    ranked = sorted(seen[1], key=lambda p: (-typical(p), p))
    first = ranked[: 2 * landmarks // 3]
    common = sorted(seen[0], key=lambda p: (-seen[0][p], p))
    chosen = first + [p for p in common[:landmarks] if p not in set(first)][: landmarks - len(first)]
    if not chosen:
        return None
    letters = "".join(c for c, _ in Counter(c for p in chosen for c in p).most_common())
    marks = Landmarks(chosen, letters)
    value, vector = np.linalg.eigh(marks.kernel(chosen))
    good = value > 1e-4 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])

    flat = sorted({p for sents, _ in docs for s in sents for t in s for p in stretches(t)})
    row = {p: i for i, p in enumerate(flat)}
    sentences, owner, label = [], [], []
    for d, (sents, y) in enumerate(docs):
        for s in sents:
            sentences.append(np.array([row[p] for t in s for p in stretches(t)]))
            owner.append(d)
            label.append(y)
    owner_ = np.array(owner, np.int64)
    # Before the first fit, a term's own typicality stands in for its margin.
    rare = np.array([typical(p) for p in flat])
    margin, enough = rare, TYPICAL
    hard: set[int] = set()  # strongest terms of clean sentences, of all rounds
    model = Model(marks.alphabet, np.zeros(1), 0.0)
    for _ in range(ROUNDS):
        # A toxic text's sentences are positive by their strong terms; a clean text's
        # sentences are negative by their strongest.
        strong = Counter(
            int(i) for s, y in zip(sentences, label) if y for i in s[(margin[s] >= enough) & (rare[s] > 0)]
        )
        if not strong:
            strong = Counter(int(s[np.argmax(margin[s])]) for s, y in zip(sentences, label) if y)
        hard |= {int(s[np.argmax(margin[s])]) for s, y in zip(sentences, label) if not y}
        positive, negative = sorted(strong), sorted(hard)
        x = marks.kernel([flat[i] for i in positive + negative]) @ whiten
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        often = np.concatenate([[strong[i] for i in positive], np.ones(len(negative))])
        weights, bias = _svm(x, y, often)
        folded = np.zeros(marks.alphabet.count, np.float32)
        used = np.flatnonzero(marks.place)
        folded[used] = (marks.table @ (whiten @ weights))[marks.place[used]]
        model = Model(marks.alphabet, folded, bias)
        margin, enough = model.pieces(flat) + bias, 0.0
    top = np.full(len(docs), model.bias)
    np.maximum.at(top, owner_, np.array([margin[s].max() for s in sentences]))
    truth = np.array([y for _, y in docs])
    # The cutoff 0.5 lies where most training texts are on their right side: in the middle
    # of the widest gap that does so.
    order = np.unique(top)
    edges = np.concatenate(([order[0] - 1], order, [order[-1] + 1]))
    cuts = (edges[1:] + edges[:-1]) / 2
    pos, neg = np.sort(top[truth == 1]), np.sort(top[truth == 0])
    wrong = np.searchsorted(pos, cuts) / n[1] + CLEAN_COST * (len(neg) - np.searchsorted(neg, cuts)) / n[0]
    least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    cut = float(cuts[least[int(np.argmax((edges[1:] - edges[:-1])[least]))]])
    cut = min(cut, HIGHEST_CUT)
    spread = float(np.std(top)) or 1.0
    model.slope = 4.0 / spread
    model.shift = -model.slope * cut
    return model


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TEXTS) -> Model | None:
    """Train on labelled rows outside the held-out fold, at most ``limit`` texts per class."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
        .distinct()
    )
    draw = F.xxhash64(F.lit(5), "doc_id")
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(draw, "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.union(part)
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .collect()
    )
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"] or "", r["toxic"]))
    return train([(r["text"] or "", r["toxic"]) for r in rows])


def score_texts(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every text."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))

    memo: dict[str, float] = {}

    def best_of(texts: list[str]) -> list[float]:
        """Largest margin of each text; words new to the memo are scored together."""
        names = [set(t.split()) for t in texts]
        fresh = sorted(set().union(*names) - memo.keys())
        if len(memo) + len(fresh) > MEMO:
            memo.clear()
            fresh = sorted(set().union(*names))
        known = [terms(w) for w in fresh]
        values = iter(model.margins([x for xs in known for x in xs]).tolist())
        memo.update((w, max([next(values) for _ in xs], default=model.bias)) for w, xs in zip(fresh, known))
        out = []
        for text, own in zip(texts, names):
            best = max(map(memo.__getitem__, own), default=model.bias)
            if _SPELLED.search(text):
                # single characters in a row make one term
                spelled = [x for m in _SPELLED.finditer(text) for x in terms(m.group())]
                best = max([best, *model.margins(spelled).tolist()])
            out.append(best)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            if model is None:
                scores = [0.0] * len(batch)
            else:
                part: list[str] = []
                weight = 0
                for t in batch.column(1):
                    part.append(t.as_py() or "")
                    weight += len(part[-1])
                    if weight > PART_CHARS:
                        scores += [model.score(x) for x in best_of(part)]
                        part, weight = [], 0
                if part:
                    scores += [model.score(x) for x in best_of(part)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return plain.mapInArrow(run, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_texts(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
