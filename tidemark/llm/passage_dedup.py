"""Substring dedup: fuzzy repeated passages by collinear chaining of k-mer seeds.

1. *Seeds.*  Texts are words (A-Z lower-cased); of every ``WINDOW`` neighbouring runs of
   ``K`` words the one with the smallest hash is kept (winnowing), so two texts that share
   ``WINDOW + K - 1`` words in a row share a seed.
2. *Meeting.*  A seed found in more than one text is linked to its *home*, the smallest
   text (by id) that has it, and its first place there.  A seed that n texts share makes n
   rows, not n * n: a passage is matched with its first holder, who is its representative.
   The seeds are dealt out once and met in the order of their rows.
3. *Chaining.*  The seeds of a text and a home are points (place here, place there).  A
   Fenwick tree over the places there finds the best earlier point of a chain, with gap
   costs by the distance on both sides, in n log n.
4. *Alignment.*  The words around a chain are looked up in blocks of ``BLOCK`` word hashes
   and aligned in the band that the chain's seeds span; a passage is kept when at least ``MIN_WORDS`` words on both sides
   align with at least ``MIN_SAME`` of them equal.
5. *Other holders.*  Neighbouring seeds of a passage may have different homes, each with less
   than a passage of it.  Seeds whose home has no passage that covers what is shared around them
   are looked at again in all texts that have them: there every run of ``min_words`` words is a key of its own, and meets
   at the first text that has all of it.  So of texts that share a run of ``min_words`` words
   each is linked with another, whatever homes its seeds have.

Every copy and every other holder of a passage comes out with the home's doc_id; the home
itself is the holder that stays.  A passage within one text only is not reported.  Null,
empty and shorter texts and null ids have no passages.  Repeated rows (same id and text)
give the same rows once; an id on different texts is taken as one text, of whose blocks the
longest count.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.tokens import pieces, runs, signed, word_bounds, words
from tidemark.session import join_checked, settle

K = 8
WINDOW = 12
BLOCK = 64
MIN_WORDS = 50
MIN_SAME = 0.8
GAP = 0.05  # cost of a word of distance between two seeds, on either side
REACH = 24  # words beyond a chain's ends that an alignment may add


def winnow(h: np.ndarray, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Places of the seeds of one text: the smallest run hash of every window."""
    r = runs(h, k)
    if not len(r):
        return np.zeros(0, np.int64)
    if len(r) <= window:
        return np.array([int(r.argmin())])
    view = np.lib.stride_tricks.sliding_window_view(r, window)
    return np.unique(view.argmin(axis=1) + np.arange(len(view)))


def winnow_all(r: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """``winnow`` of many texts at once: places of the smallest of every window of run hashes.

    Text i has the runs ``begin[i]`` to ``end[i]`` of ``r``; windows do not cross texts.  The
    first smallest of a window is that of its two halves' firsts, so it takes log(window) steps.
    """
    if not len(r):
        return np.zeros(0, np.int64)
    size, low = 1, np.arange(len(r))
    while size < window and len(low) > (step := min(size, window - size)):
        left, right = low[: len(low) - step], low[step:]
        low = np.where(r[left] <= r[right], left, right)
        size += step
    few = np.flatnonzero((end > begin) & (end - begin <= window))
    out = [b + int(r[b:e].argmin()) for b, e in zip(begin[few].tolist(), end[few].tolist())]
    many = end - begin > window
    starts = np.zeros(len(r) + 1, np.int64)
    np.add.at(starts, begin[many], 1)
    np.add.at(starts, end[many] - window + 1, -1)
    chosen = np.zeros(len(r), bool)
    if many.any():
        chosen[low[np.flatnonzero(np.cumsum(starts)[: len(low)])]] = True
    chosen[out] = True
    return np.flatnonzero(chosen)


def _seeds(docs: DataFrame) -> DataFrame:
    """Seeds (seed, doc_id, at) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offs in pieces(batch.column(1)):
                h, start, _ = words(data, offs)
                at = word_bounds(start, offs)
                begin, end = at[:-1], np.maximum(at[:-1], at[1:] - K + 1)
                if len(h) < K:
                    continue
                r = runs(h, K)
                p = winnow_all(r, begin, end)
                own = np.searchsorted(at, p, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(r[p]), pa.int64()),
                        pa.array(ids[i + own].astype(np.int64), pa.int64()),
                        pa.array(p - at[own], pa.int32()),
                    ],
                    names=["seed", "doc_id", "at"],
                )

    return docs.mapInArrow(run, "seed long, doc_id long, at int")


def _blocks(docs: DataFrame) -> DataFrame:
    """Words of all texts in blocks (doc_id, block, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, offs in pieces(batch.column(1)):
                h, start, _ = words(data, offs)
                at = word_bounds(start, offs)
                small = (h >> np.uint64(32)).astype(np.uint32)
                many = -(-np.diff(at) // BLOCK)
                own = np.repeat(np.arange(j - i), many)
                block = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
                cuts = np.append(at[own] + block * BLOCK, len(small)).astype(np.int32) * 4
                parts = pa.Array.from_buffers(
                    pa.binary(), len(own), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(small)]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i + own].astype(np.int64), pa.int64()), pa.array(block, pa.int32()), parts],
                    names=["doc_id", "block", "words"],
                )

    return docs.mapInArrow(run, "doc_id long, block int, words binary")


MET = "seed long, doc_id long, home_id long, at int, home_at int"


def _met(seeds: DataFrame) -> DataFrame:
    """Rows of ``seeds`` that several texts share, with the smallest text and its first place.

    Rows come sorted, so a seed's first row is its home's; the home's own rows wait until
    another text shows up, and of a seed with many texts nothing else is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        known: tuple | None = None  # a seed that is shared, its home and the place there
        for batch in batches:
            seed, doc, at = (
                np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns)
            )
            if not len(seed):
                continue
            first = np.append(True, seed[1:] != seed[:-1])
            group = np.cumsum(first) - 1
            starts = np.flatnonzero(first)
            home, place = doc[starts], at[starts]
            shared = np.zeros(len(starts), bool)
            if known is not None and known[0] == seed[0]:
                home[0], place[0], shared[0] = known[1], known[2], True
            shared[group[doc != home[group]]] = True
            last = len(starts) - 1
            out = shared[group]
            if shared[last]:
                known = int(seed[-1]), int(home[last]), int(place[last])
                held = [x[:0] for x in (seed, doc, at)]
            else:
                known = None
                held = [x[starts[last] :] for x in (seed, doc, at)]
            if out.any():
                g = group[out]
                arrays = [seed[out], doc[out], home[g], at[out], place[g]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(arrays, [pa.int64()] * 3 + [pa.int32()] * 2)],
                    names=["seed", "doc_id", "home_id", "at", "home_at"],
                )

    return seeds.repartition("seed").sortWithinPartitions("seed", "doc_id", "at").mapInArrow(run, MET)


def _whole(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by ``key``, cut where the key changes: no group is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(own, own[-1], "left"))
        before = held and held[0].column(key)[0].as_py() != own[0]
        if cut or before:
            if cut:
                held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def chains(x: list[int], y: list[int], k: int = K, gap: float = GAP) -> list[list[int]]:
    """Collinear chains of the seed matches (x[i], y[i]), best first, as lists of positions.

    A chain scores ``k`` per seed, less ``gap`` for every word from seed to seed on either
    side.  As that cost is a sum over both axes, the best predecessor is the largest
    score + gap * (x + y) among the points to the lower left: a prefix maximum, kept by a
    Fenwick tree over y while x grows.
    """
    n = len(x)
    order = sorted(range(n), key=lambda i: (x[i], -y[i]))
    ys = sorted(set(y))
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ys) + 1)
    score, back = [float(k)] * n, [-1] * n
    for i in order:
        at = bisect_left(ys, y[i])
        best = (-1e18, -1)
        j = at
        while j > 0:
            best = max(best, tree[j])
            j -= j & -j
        joined = k + best[0] - gap * (x[i] + y[i])
        if joined > score[i]:
            score[i], back[i] = joined, best[1]
        entry = (score[i] + gap * (x[i] + y[i]), i)
        j = at + 1
        while j <= len(ys):
            tree[j] = max(tree[j], entry)
            j += j & -j
    used = [False] * n
    out = []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        chain = []
        p = i
        while p >= 0 and not used[p]:
            used[p] = True
            chain.append(p)
            p = back[p]
        if chain:
            out.append(chain[::-1])
    return out


def cut_wide(chain: list[int], x: list[int], y: list[int], widest: int = BLOCK) -> list[list[int]]:
    """A chain cut where two seeds are more than ``widest`` words apart on a side."""
    out = [[chain[0]]]
    for a, b in zip(chain, chain[1:]):
        if max(x[b] - x[a], y[b] - y[a]) > widest:
            out.append([])
        out[-1].append(b)
    return out


def _common(a: list[int], b: list[int]) -> int:
    """Words that an alignment of two short gaps keeps: equal ends, then the programme."""
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    row = [0] * (len(b) + 1)
    for x in a if b else []:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return i + j + row[-1]


def _extend(equal: np.ndarray, loss: int = 1) -> tuple[int, int]:
    """How far a stretch goes on along a diagonal, and its equal words: +1 and -loss a word."""
    if not len(equal):
        return 0, 0
    gain = np.cumsum(np.where(equal, 1, -loss))
    best = int(gain.argmax())
    return (best + 1, int(equal[: best + 1].sum())) if gain[best] > 0 else (0, 0)


def align(
    a: np.ndarray, b: np.ndarray, xs: list[int], ys: list[int], k: int = K, loss: int = 1
) -> tuple[int, int, int, int, int]:
    """Alignment of two word sequences along a chain of seeds (xs[i], ys[i]) of ``k`` words.

    The band is the chain itself: words between seeds on one diagonal are compared one to
    one, gaps between diagonals by their own small programme, and both ends go on along
    their diagonal while that gains.  Gives (begin a, end a, begin b, end b, equal words).
    """
    x0, y0 = xs[0], ys[0]
    ea, eb, same = x0 + k, y0 + k, k
    for x, y in zip(xs[1:], ys[1:]):
        if x - y == ea - eb:
            if x > ea:
                same += int((a[ea:x] == b[eb:y]).sum())
            same += x + k - max(x, ea)
        else:
            over = max(0, ea - x, eb - y)
            if over >= k:
                continue
            x, y = x + over, y + over
            same += _common(a[ea:x].tolist(), b[eb:y].tolist()) + k - over
            x, y = x - over, y - over
        ea, eb = x + k, y + k
    return _ends(a, b, (x0, ea, y0, eb, same), loss)


def _ends(a: np.ndarray, b: np.ndarray, core: tuple[int, int, int, int, int], loss: int) -> tuple[int, int, int, int, int]:
    x0, ea, y0, eb, same = core
    n = min(len(a) - ea, len(b) - eb)
    more, equal = _extend(a[ea : ea + n] == b[eb : eb + n], loss)
    m = min(x0, y0)
    less, before = _extend((a[x0 - m : x0] == b[y0 - m : y0])[::-1], loss)
    return x0 - less, ea + more, y0 - less, eb + more, same + equal + before


def _passage(
    a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, min_words: int, min_same: float
) -> tuple[int, int, int, int, float] | None:
    """Alignment along a chain, if it is a passage.

    Ends that go on while more than half of the words are equal may take the whole below
    ``min_same``; they then go on as far only as they do not.
    """
    straight = len(np.unique(xs - ys)) == 1
    core = None
    if straight:  # one diagonal: seeds and what lies between them are compared at once
        x0, ea, y0, eb = int(xs[0]), int(xs[-1]) + K, int(ys[0]), int(ys[-1]) + K
        if 0 <= x0 and 0 <= y0 and ea <= len(a) and eb <= len(b):
            core = x0, ea, y0, eb, int(np.count_nonzero(a[x0:ea] == b[y0:eb]))
    for loss in (1, max(1, round(min_same / max(1e-9, 1 - min_same)))):
        i, j, p, q, same = _ends(a, b, core, loss) if core else align(a, b, xs.tolist(), ys.tolist(), loss=loss)
        if min(j - i, q - p) >= min_words and same >= min_same * max(j - i, q - p):
            return i, j, p, q, same / max(j - i, q - p)
    return None


def _lone_passages(
    flat: np.ndarray, x: np.ndarray, x0: np.ndarray, x1: np.ndarray, y: np.ndarray, y0: np.ndarray, y1: np.ndarray,
    min_words: int, min_same: float,
) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """``_passage`` of many chains of one seed: which are one, and (begin, end, begin, end, same) of these.

    Seeds lie at ``x`` and ``y`` of ``flat``, among the words x0 to x1 and y0 to y1 there.
    """
    steps = np.arange(REACH)

    def equal(a: np.ndarray, b: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """1, 0 for equal and other words, -1 beyond the end of either side."""
        same = flat[np.where(inside, a, 0)] == flat[np.where(inside, b, 0)]
        return np.where(inside, same.astype(np.int64), -1)

    core = (flat[np.minimum(x[:, None] + np.arange(K), len(flat) - 1)] == flat[np.minimum(y[:, None] + np.arange(K), len(flat) - 1)]).sum(axis=1)
    room = np.minimum(x1 - x, y1 - y) - K, np.minimum(x - x0, y - y0)
    fits = (room[0] >= 0) & (room[1] >= 0)
    ahead = equal(x[:, None] + K + steps, y[:, None] + K + steps, steps < room[0][:, None])
    back = equal(x[:, None] - 1 - steps, y[:, None] - 1 - steps, steps < room[1][:, None])

    def on(ends: np.ndarray, loss: int) -> tuple[np.ndarray, np.ndarray]:
        gain = np.cumsum(np.where(ends == 1, 1, np.where(ends == 0, -loss, -(10**6))), axis=1)
        best = gain.argmax(axis=1)
        rows = np.arange(len(ends))
        some = gain[rows, best] > 0
        hits = np.cumsum(ends == 1, axis=1)[rows, best]
        return np.where(some, best + 1, 0), np.where(some, hits, 0)

    good = np.zeros(len(x), bool)
    longer, shorter, same = (np.zeros(len(x), np.int64) for _ in range(3))
    for loss in (1, max(1, round(min_same / max(1e-9, 1 - min_same)))):
        (more, hits), (less, before) = on(ahead, loss), on(back, loss)
        total, kept = K + more + less, core + hits + before
        new = ~good & fits & (total >= min_words) & (kept >= min_same * total)
        longer[new], shorter[new], same[new] = more[new], less[new], kept[new]
        good |= new
    x, y, longer, shorter, same = (c[good] for c in (x, y, longer, shorter, same))
    return good, (x - shorter, x + K + longer, y - shorter, y + K + longer, same / (K + longer + shorter))


CHAINS = "doc_id long, home_id long, x0 long, x1 long, y0 long, y1 long, low long, points binary, seed long"


def _chain_row(doc: int, home: int, xs: np.ndarray, ys: np.ndarray) -> tuple:
    ends = max(0, int(xs[0]) - REACH), int(xs[-1]) + K + REACH, max(0, int(ys[0]) - REACH), int(ys[-1]) + K + REACH
    return doc, home, *ends, int(xs[0]), np.concatenate([xs, ys]).astype(np.int32).tobytes(), None


def _chain_batch(rows: list[tuple]) -> pa.RecordBatch:
    return _chain_arrays(*(list(zip(*rows)) or [()] * 9))


def _chain_arrays(*columns: object) -> pa.RecordBatch:
    """Rows of ``CHAINS`` from its columns; None is a column of nulls."""
    types = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
    names = [x.strip().split(" ")[0] for x in CHAINS.split(",")]
    n = len(columns[0])
    made = [c if isinstance(c, pa.Array) else pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays(made, names=names)


def _lone_chains(doc: np.ndarray, home: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """``_chain_row`` of many chains of one seed each."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    both = np.stack([x, y], axis=1).astype(np.int32)
    cuts = np.arange(len(x) + 1, dtype=np.int32) * 8
    points = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(cuts), pa.py_buffer(both.ravel())])
    return _chain_arrays(doc, home, np.maximum(x - REACH, 0), x + K + REACH, np.maximum(y - REACH, 0), y + K + REACH, x, points, None)


def _straight(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]] | None:
    """Chains of points on one diagonal, cut where they are wide: the best are all in a row."""
    if len(x) > 1 and ((x[1:] - y[1:]) != (x[0] - y[0])).any():
        return None
    cuts = [0, *(np.flatnonzero(np.diff(x) > BLOCK) + 1).tolist(), len(x)]
    return list(zip(cuts, cuts[1:]))


def _sure(x: np.ndarray, min_words: int, min_same: float) -> bool:
    """Whether seeds on one diagonal are a passage in themselves, whatever lies around them."""
    whole = int(x[-1] - x[0]) + K
    return whole >= min_words and K + int(np.minimum(np.diff(x), K).sum()) >= min_same * whole


def _chained(met: DataFrame, min_words: int, min_same: float) -> DataFrame:
    """Chains of every text with each of its homes, and rows (doc_id, home_id, x0, x1, seed) of open seeds.

    Open are those in a stretch of shared seeds that may be a passage (seeds of a text are at most
    ``WINDOW`` apart, and all seeds of a passage are shared), unless a sure chain covers the words
    x0 to x1: what may be in one run of ``min_words`` words with the seed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for table in _whole(batches, "doc_id"):
            doc, home, at, there, seed = (_column(table, c) for c in ("doc_id", "home_id", "at", "home_at", "seed"))
            new = np.append(True, (doc[1:] != doc[:-1]) | (home[1:] != home[:-1]))
            # a place has one seed, unless the id is on several texts
            keep = new | np.append(True, at[1:] != at[:-1])
            doc, home, at, there, seed, new = (c[keep] for c in (doc, home, at, there, seed, new))
            own = doc == home
            # words that a sure chain of the row covers
            lows, highs = np.where(own, 0, 2**31), np.where(own, 2**31, 0)
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(doc)))
            lone = starts[(size == 1) & ~own[starts] & (K + 2 * REACH >= min_words)]
            if len(lone):
                yield _lone_chains(doc[lone], home[lone], at[lone], there[lone])
            more = (size > 1) & ~own[starts]
            for a, b in zip(starts[more].tolist(), (starts + size)[more].tolist()):
                x, y = at[a:b].astype(np.int64), there[a:b].astype(np.int64)
                d, h = int(doc[a]), int(home[a])
                found = _straight(x, y)
                if found is not None:
                    for i, j in found:
                        if int(x[j - 1] - x[i]) + K + 2 * REACH >= min_words:
                            out.append(_chain_row(d, h, x[i:j], y[i:j]))
                        if _sure(x[i:j], min_words, min_same):
                            lows[a + i : a + j], highs[a + i : a + j] = x[i], x[j - 1] + K
                    continue
                xl, yl = x.tolist(), y.tolist()
                for c in [piece for whole in chains(xl, yl) for piece in cut_wide(whole, xl, yl)]:
                    xs, ys = x[c], y[c]
                    if min(xs[-1] - xs[0], ys[-1] - ys[0]) + K + 2 * REACH < min_words:
                        continue
                    out.append(_chain_row(d, h, xs, ys))
                    if (xs - ys == xs[0] - ys[0]).all() and _sure(xs, min_words, min_same):
                        lows[a + np.array(c)], highs[a + np.array(c)] = xs[0], xs[-1] + K
            left, low, high = open_seeds(doc, at, lows, highs, min_words)
            if len(left):
                yield _chain_arrays(doc[left], home[left], low, high, None, None, at[left].astype(np.int64), None, seed[left])
            if len(out) > 5000:
                yield _chain_batch(out)
                out = []
        yield _chain_batch(out)

    dealt = met.repartition("doc_id").sortWithinPartitions("doc_id", "home_id", "at", "home_at")
    return dealt.mapInArrow(run, CHAINS).withColumn("chain", F.xxhash64("doc_id", "home_id", "x0", "x1", "y0", "y1", "points"))


def stretches(doc: np.ndarray, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last row (of rows sorted by text and place) of seeds that may be in one passage."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.append(True, (doc[1:] != doc[:-1]) | (np.diff(at) > WINDOW))
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(doc)) - 1
    # A run of min_words words has its first seed in the first WINDOW places, its last in the last.
    fits = at[last] - at[first] >= max(0, min_words - K + 1 - 2 * WINDOW + 1)
    return first[fits], last[fits]


def open_seeds(
    doc: np.ndarray, at: np.ndarray, lows: np.ndarray, highs: np.ndarray, min_words: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of seeds in a stretch, and the words of it around each, where ``lows`` to ``highs`` lack some of these."""
    order = np.lexsort((at, doc))
    first, last = stretches(doc[order], at[order], min_words)
    n = last - first + 1
    rows = order[np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
    place = at[rows].astype(np.int64)
    around = max(0, min_words - K)
    low = np.maximum(np.repeat(at[order][first], n), place - around)
    high = np.minimum(np.repeat(at[order][last], n) + K, place + K + around)
    left = (lows[rows] > low) | (highs[rows] < high)
    return rows[left], low[left], high[left]


def _aligned(found: DataFrame, table: DataFrame, min_words: int, min_same: float) -> DataFrame:
    """Passages of ``found`` chains; words come from the blocks in ``table``."""
    ask = lambda side, own, lo, hi: found.select(
        "chain",
        F.lit(side).alias("side"),
        F.col(own).alias("doc_id"),
        F.col(lo).alias("lo"),
        F.col(hi).alias("hi"),
        F.col("points") if side == 0 else F.lit(None).cast("binary").alias("points"),
    )
    asked = ask(0, "doc_id", "x0", "x1").union(ask(1, "home_id", "y0", "y1"))
    low, high = (F.floor(c / BLOCK).cast("int") for c in (F.col("lo"), F.col("hi") - 1))
    asked = asked.withColumn("block", F.explode(F.sequence(low, high))).select(
        "chain", "side", "doc_id", "block", F.when(F.col("block") == low, F.col("points")).alias("points")
    )

    def side(blocks: np.ndarray, offsets: np.ndarray, data: np.ndarray, a: int, b: int) -> tuple[np.ndarray, int]:
        """Words of rows a to b and the first one's place; of a block that is there twice the longest."""
        begin = int(blocks[a]) * BLOCK
        if (blocks[a + 1 : b] == blocks[a : b - 1]).any():
            chosen: dict[int, bytes] = {}
            every = sorted((int(blocks[i]), data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(a, b))
            for n, part in every:
                chosen[n] = max(chosen.get(n, b""), part, key=len)
            return np.frombuffer(b"".join(chosen[n] for n in sorted(chosen)), np.uint32), begin
        return data[offsets[a] : offsets[b]].view(np.uint32), begin

    def line_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "home_id", "home_start", "home_end", "same"]
        types = [pa.int64()] * 6 + [pa.float64()]
        for table in _whole(batches, "chain"):
            chain, sides, block, doc = (_column(table, c) for c in ("chain", "side", "block", "doc_id"))
            parts, points = (table.column(c).combine_chunks() for c in ("words", "points"))
            parts, points = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (parts, points))
            _, offsets, data = parts.buffers()
            offsets = np.frombuffer(offsets, np.int32)[parts.offset : parts.offset + len(parts) + 1]
            data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            cuts = [*np.flatnonzero(np.append(True, chain[1:] != chain[:-1])).tolist(), len(chain)]
            other = np.searchsorted(sides + 2 * np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), 2 * np.arange(len(cuts) - 1) + 1)
            begin, middle, end = np.array(cuts[:-1]), other, np.array(cuts[1:])
            whole = (middle > begin) & (middle < end)
            begin, middle, end = begin[whole], middle[whole], end[whole]
            _, point_offsets, point_data = points.buffers()
            point_offsets = np.frombuffer(point_offsets, np.int32)[points.offset : points.offset + len(points) + 1]
            # of a block that is there twice the longest counts: those chains are looked at one by one
            again = np.append(False, (chain[1:] == chain[:-1]) & (sides[1:] == sides[:-1]) & (block[1:] == block[:-1]))
            twice = np.cumsum(again)
            lone = (point_offsets[begin + 1] - point_offsets[begin] == 8) & (twice[end - 1] == twice[begin])
            out = []
            if lone.any():
                a, m, b = begin[lone], middle[lone], end[lone]
                pairs = np.frombuffer(point_data, np.int32).astype(np.int64)
                x, y = pairs[point_offsets[a] // 4], pairs[point_offsets[a] // 4 + 1]
                word, flat = offsets // 4, data[: int(offsets[-1])].view(np.uint32)
                hx, hy = word[a] - block[a].astype(np.int64) * BLOCK, word[m] - block[m].astype(np.int64) * BLOCK
                good, found_ = _lone_passages(flat, hx + x, word[a], word[m], hy + y, word[m], word[b], min_words, min_same)
                i, j, p, q, same = found_
                a, m, hx, hy = a[good], m[good], hx[good], hy[good]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip([doc[a], i - hx, j - hx, doc[m], p - hy, q - hy, same], types)], names=names
                )
            for a, m, b in zip(begin[~lone].tolist(), middle[~lone].tolist(), end[~lone].tolist()):
                xy = np.frombuffer(points[a].as_py(), np.int32).astype(np.int64)
                xs, ys = xy[: len(xy) // 2], xy[len(xy) // 2 :]
                here, a0 = side(block, offsets, data, a, m)
                there, b0 = side(block, offsets, data, m, b)
                lo, hi = max(0, int(xs[0]) - REACH), int(xs[-1]) + K + REACH
                here, a0 = here[max(0, lo - a0) : hi - a0], max(lo, a0)
                lo, hi = max(0, int(ys[0]) - REACH), int(ys[-1]) + K + REACH
                there, b0 = there[max(0, lo - b0) : hi - b0], max(lo, b0)
                got = _passage(here, there, xs - a0, ys - b0, min_words, min_same)
                if got:
                    i, j, p, q, same = got
                    out.append((int(doc[a]), a0 + i, a0 + j, int(doc[m]), b0 + p, b0 + q, same))
            columns = list(zip(*out)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return (
        asked.join(table, ["doc_id", "block"])
        .select("chain", "side", "block", "doc_id", "words", "points")
        .repartition("chain")
        .sortWithinPartitions("chain", "side", "block")
        .mapInArrow(line_up, "doc_id long, start long, end long, home_id long, home_start long, home_end long, same double")
    )


def _ranges(met: DataFrame, min_words: int) -> DataFrame:
    """Word ranges (doc_id, lows, highs) of every text that a passage of all these seeds may be in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, "doc_id"):
            doc, at = _column(table, "doc_id"), _column(table, "at").astype(np.int64)
            spans: dict[int, list[list[int]]] = {}
            for a, b in zip(*stretches(doc, at, min_words)):
                span = [max(0, int(at[a]) - WINDOW + 1), int(at[b]) + K + WINDOW - 1]
                own = spans.setdefault(int(doc[a]), [])
                if own and span[0] <= own[-1][1]:  # runs that lie in both are made once
                    own[-1][1] = span[1]
                else:
                    own.append(span)
            lists = [[[s[i] for s in own] for own in spans.values()] for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(spans), pa.int64())] + [pa.array(x, pa.list_(pa.int64())) for x in lists],
                names=["doc_id", "lows", "highs"],
            )

    dealt = met.select("doc_id", "at").repartition("doc_id").sortWithinPartitions("doc_id", "at")
    return dealt.mapInArrow(run, "doc_id long, lows array<long>, highs array<long>")


def _long_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """Every run of ``min_words`` words (seed, doc_id, at) in the ranges ``lows`` to ``highs`` of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lows, highs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j, data, offs in pieces(batch.column(1)):
                h, start, _ = words(data, offs)
                bounds = word_bounds(start, offs)
                keys, own, at = [], [], []
                for d in range(j - i):
                    part = h[bounds[d] : bounds[d + 1]]
                    for lo, hi in zip(lows[i + d], highs[i + d]):
                        if len(part[lo:hi]) < min_words:
                            continue
                        r = runs(part[lo:hi], min_words)
                        keys.append(r)
                        own.append(np.full(len(r), ids[i + d], np.int64))
                        at.append(lo + np.arange(len(r)))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(np.concatenate(keys)), pa.int64()),
                            pa.array(np.concatenate(own), pa.int64()),
                            pa.array(np.concatenate(at), pa.int32()),
                        ],
                        names=["seed", "doc_id", "at"],
                    )

    return docs.select("doc_id", "text", "lows", "highs").mapInArrow(run, "seed long, doc_id long, at int")


def needed_runs(doc: np.ndarray, home: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[int]:
    """Those of the ranges that cover all words of a text that a home's ranges cover: others lie in these.

    Ranges come by text, home and beginning.  A text that repeats itself has a range for each
    of its repeats, most of them within the others.
    """
    out: list[int] = []
    own: tuple | None = None
    covered, reach, best = 0, 0, -1  # up to where it is covered, and the range that goes on farthest
    for i, (d, h, a, b) in enumerate(zip(doc.tolist(), home.tolist(), low.tolist(), high.tolist())):
        if (d, h) != own or a > covered:
            if best >= 0:
                out.append(best)
                covered, best = reach, -1
            if (d, h) != own or a > covered:
                own, covered, reach = (d, h), b, b
                out.append(i)
                continue
        if b > max(reach, covered):
            reach, best = b, i
    if best >= 0:
        out.append(best)
    return out


def _run_chains(met: DataFrame, min_words: int) -> DataFrame:
    """Chains of long runs that follow each other in a text and its home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for table in _whole(batches, "doc_id"):
            doc, home, at, there = (_column(table, c).astype(np.int64) for c in ("doc_id", "home_id", "at", "home_at"))
            order = np.lexsort((at, at - there, home, doc))
            doc, home, at, there = (c[order] for c in (doc, home, at, there))
            new = np.append(True, (np.diff(doc) != 0) | (np.diff(home) != 0) | (np.diff(at - there) != 0) | (np.diff(at) > 1))
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(doc))
            order = np.lexsort((-at[ends - 1], at[starts], home[starts], doc[starts]))
            starts, ends = starts[order], ends[order]
            kept = needed_runs(doc[starts], home[starts], at[starts], at[ends - 1] + min_words)
            for a, b in zip(starts[kept].tolist(), ends[kept].tolist()):
                steps = np.unique(np.append(np.arange(0, int(at[b - 1] - at[a]) + min_words - K, K), at[b - 1] - at[a] + min_words - K))
                out.append(_chain_row(int(doc[a]), int(home[a]), at[a] + steps, there[a] + steps))
            if len(out) > 5000:
                yield _chain_batch(out)
                out = []
        yield _chain_batch(out)

    dealt = met.where("doc_id <> home_id").repartition("doc_id").sortWithinPartitions("doc_id", "home_id", "at")
    return dealt.mapInArrow(run, CHAINS).withColumn("chain", F.xxhash64("doc_id", "home_id", "x0", "x1", "y0", "y1", "points"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_same: float = MIN_SAME) -> DataFrame:
    """doc_id, start, end, home_id, home_start, home_end, same: word ranges of each passage."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null and text is not null"
    )
    met = stored(_met(_seeds(plain)), "seeds-met")
    found = stored(_chained(met, min_words, min_same), "chains")
    passages = _aligned(found.where("points is not null"), _blocks(plain), min_words, min_same)
    open_ = found.where("points is null").select("doc_id", "home_id", F.col("x0").alias("low"), F.col("x1").alias("high"), "seed")
    if open_.limit(1).count() == 0:
        return passages

    passages = stored(passages, "passages")
    known = passages.select(
        F.col("doc_id").alias("d"), F.col("home_id").alias("h"), F.col("start").alias("lo"), F.col("end").alias("hi")
    )

    def not_in_known(rows: DataFrame, high: str) -> DataFrame:
        inside = F.expr(f"doc_id = d and home_id = h and lo <= low and {high} <= hi")
        return rows.join(known, inside, "left_anti")

    asks = stored(not_in_known(open_, "high").select("seed").distinct(), "seeds-open")
    ranges = settle(_ranges(met.join(asks, "seed", "left_semi"), min_words))
    ranged = join_checked(plain, ranges, ["doc_id"], even=True)
    runs_ = _run_chains(_met(_long_runs(ranged, min_words)), min_words)
    more = stored(not_in_known(runs_, f"x1 - {REACH}"), "chains-open")
    wanted = more.select("doc_id").union(more.select("home_id")).distinct()
    some = join_checked(plain, settle(wanted), ["doc_id"], even=True)
    return passages.union(_aligned(more, _blocks(some), min_words, min_same))
