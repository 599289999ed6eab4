"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and items are compared in canonical form: A-Z lower-cased, every run of other ASCII
characters than letters and digits one space.  An item of length L may differ by
``e = floor(rate * L)`` edits; a region within that budget shares at least
``L + 1 - q - q * e`` q-grams with the item, all inside one of the overlapping diagonal
bands.  Per text:

1. every q-gram (8 bytes, packed exactly into one number) is looked up in a bitmap of the
   items' q-grams; windows with too few hits for any item are passed over,
2. in the others the shared q-grams are counted per item and diagonal band, bands that
   reach the lemma's bound are retained,
3. a banded alignment of the item with the region finds the fewest edits; regions within
   the budget are reported.

The work is one narrow pass over the documents.  Items are taken in blocks of a bounded
number of bytes (one pass and one broadcast per block), however many there are.

Null and empty texts and items match nothing.  Items shorter than q bytes are found by
exact containment between spaces.  Repeated rows and items are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.llm.tokens import pieces

Q = 8
RATE = 0.08
BLOCK_BYTES = 8 << 20
WINDOW = 64
_BITS = 22

_KIND = np.zeros(256, np.uint8)  # 0: blank, else the canonical byte
_KIND[48:58] = np.arange(48, 58)
_KIND[97:123] = np.arange(97, 123)
_KIND[65:91] = np.arange(97, 123)
_KIND[128:] = np.arange(128, 256)


def canonical(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical bytes, the original position of each, and each text's bounds in them.

    Every text begins and ends with a blank and is followed by a zero byte, which no
    q-gram of an item holds.
    """
    byte = _KIND[data]
    n = len(offs) - 1
    ends = offs[1:]
    byte = np.where(byte == 0, 32, byte).astype(np.uint8)
    blank = byte == 32
    keep = np.ones(len(byte), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    heads = offs[:-1][offs[:-1] < ends]
    keep[heads] = ~blank[heads]  # the blank at the head is put in below
    tails = ends[ends > offs[:-1]] - 1
    at = np.flatnonzero(keep)
    # drop a blank that ends a text: one is put in for every text
    is_tail = np.zeros(len(byte) + 1, bool)
    is_tail[tails] = True
    last_blank = blank[at] & (is_tail[at] | _ends_here(at, ends))
    at = at[~last_blank]
    count = np.searchsorted(at, offs, "left")
    sizes = np.diff(count)
    out = np.zeros(len(at) + 3 * n, np.uint8)
    where = np.full(len(out), -1, np.int64)
    begin = count[:-1] + 3 * np.arange(n)
    spot = np.arange(len(at)) + np.repeat(3 * np.arange(n) + 1, sizes)
    out[spot] = byte[at]
    where[spot] = at
    out[begin] = 32
    out[begin + sizes + 1] = 32
    bounds = np.append(begin, len(out))
    return out, where, bounds


def _ends_here(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Kept positions after which their text keeps nothing more."""
    if not len(at):
        return np.zeros(0, bool)
    own = np.searchsorted(ends, at, "right")
    return np.append(own[1:] != own[:-1], True)


def grams(c: np.ndarray) -> np.ndarray:
    """Packed 8-byte windows."""
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    a = c.astype(np.uint64)
    two = a[:-1] | (a[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return four[:-4] | (four[4:] << np.uint64(32))


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


@dataclass
class Index:
    """q-gram index of one block of items; its size follows the block's bytes."""

    ids: list[int]
    texts: list[bytes]  # canonical, a blank at both ends
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray  # sorted q-grams
    item: np.ndarray
    place: np.ndarray
    bitmap: np.ndarray
    least: int  # hits that a window needs

    @staticmethod
    def of(items: list[tuple[int, str]], rate: float) -> Index:
        ids, texts = [], []
        for i, t in items:
            raw = np.frombuffer((t or "").encode(), np.uint8)
            c, _, b = canonical(raw, np.array([0, len(raw)]))
            if len(raw) and b[1] - b[0] > 3:
                ids.append(i)
                texts.append(c[b[0] : b[1] - 1].tobytes())
        size = np.array([len(t) for t in texts], np.int64)
        budget = np.floor(rate * (size - 2)).astype(np.int64)
        # The lemma asks for a positive bound: very short items get a smaller budget.
        budget = np.minimum(budget, np.maximum((size - Q) // Q, 0))
        bound = size + 1 - Q - Q * budget
        parts = [grams(np.frombuffer(t, np.uint8)) for t in texts]
        keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.int64)
        place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[_slot(keys)] = True
        long_ = size >= Q
        tiles = -(-(size + budget) // WINDOW)
        least = int((-(-bound // tiles))[long_].min()) if long_.any() else 1 << 60
        return Index(ids, texts, budget, bound, keys[order], item[order], place[order], bitmap, max(1, least))


def align(item: bytes, region: bytes, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits of ``item`` against any part of ``region``: (edits, begin, end).

    Row by row over the item with all starts free; cells beyond the budget are cut to it,
    so only the band around the cheap diagonals changes.  None beyond the budget.
    """
    hit = region.find(item)
    if hit >= 0:
        return 0, hit, hit + len(item)
    b = np.frombuffer(region, np.uint8)
    n = len(b)
    ramp = np.arange(n + 1)
    cost = np.zeros(n + 1, np.int64)
    origin = ramp.copy()
    big = budget + 1
    for i, c in enumerate(item):
        diag = np.append(big, cost[:-1] + (b != c))
        dorg = np.append(0, origin[:-1])
        up = cost + 1
        take = diag <= up
        best = np.where(take, diag, up)
        org = np.where(take, dorg, origin)
        best[0] = min(i + 1, big)
        org[0] = 0
        # cheapest way in from the left: the smallest cost minus position so far
        low = np.minimum.accumulate(best - ramp)
        first = np.maximum.accumulate(np.where(best - ramp == low, ramp, 0))
        cost = np.minimum(low + ramp, big)
        origin = org[first]
        if cost.min() > budget:
            return None
    end = int(cost.argmin())
    return int(cost[end]), int(origin[end]), end


def find(index: Index, c: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, begin, end, edits) of every match in the canonical texts of a piece."""
    out: list[tuple[int, int, int, int, int]] = []
    whole = c.tobytes()
    for k, t in enumerate(index.texts):
        if len(t) < Q:
            at = whole.find(t)
            while at >= 0:
                out.append((int(np.searchsorted(bounds, at, "right")) - 1, k, at, at + len(t), 0))
                at = whole.find(t, at + len(t) - 1)
    g = grams(c)
    if not len(g) or not len(index.keys):
        return out
    hit = index.bitmap[_slot(g)]
    seen = np.concatenate(([0], np.cumsum(hit)))
    last = np.minimum(np.arange(len(g)) + WINDOW, len(g))
    dense = np.flatnonzero((seen[last] - seen[:-1] >= index.least) & hit)
    if not len(dense):
        return out
    reach = max(len(t) for t in index.texts) + int(index.budget.max()) + WINDOW
    cuts = np.flatnonzero(np.diff(dense) > 2 * reach) + 1
    for part in np.split(dense, cuts):
        first, final = max(0, part[0] - reach), min(len(g), part[-1] + reach)
        for d in range(int(np.searchsorted(bounds, first, "right")) - 1, int(np.searchsorted(bounds, final, "left"))):
            lo, hi = max(first, bounds[d]), min(final, bounds[d + 1] - 1)
            if hi - lo < 1:
                continue
            out += [(d, *m) for m in _in_text(index, c, g, hit, int(lo), int(hi), int(bounds[d]), int(bounds[d + 1]) - 1)]
    return list(dict.fromkeys(out))


def _in_text(
    index: Index, c: np.ndarray, g: np.ndarray, hit: np.ndarray, lo: int, hi: int, begin: int, end: int
) -> list[tuple[int, int, int, int]]:
    at = np.flatnonzero(hit[lo:hi]) + lo
    left = np.searchsorted(index.keys, g[at], "left")
    many = np.searchsorted(index.keys, g[at], "right") - left
    total = int(many.sum())
    if not total:
        return []
    which = np.repeat(left - (np.cumsum(many) - many), many) + np.arange(total)
    item, diagonal = index.item[which], np.repeat(at, many) - index.place[which]
    # Items with too few hits on all diagonals together go first.
    rich = np.bincount(item, minlength=len(index.ids)) >= index.bound
    ok = rich[item]
    item, diagonal = item[ok], diagonal[ok]
    if not len(item):
        return []
    width = 2 * (index.budget[item] + 1)
    shifted = diagonal - diagonal.min()
    out: list[tuple[int, int, int, int]] = []
    regions: dict[int, list[tuple[int, int]]] = {}
    for half in (0, 1):  # overlapping bands: every stretch of budget + 1 diagonals is in one
        band = (shifted + half * (width // 2)) // width
        key = item * (int(shifted.max()) + 2) + band
        order = np.argsort(key, kind="stable")
        keys, first, counts = np.unique(key[order], return_index=True, return_counts=True)
        for f, n in zip(first, counts):
            k = int(item[order[f]])
            if n >= index.bound[k]:
                own = diagonal[order[f : f + n]]
                regions.setdefault(k, []).append((int(own.min()), int(own.max())))
    for k, spans in regions.items():
        e, size = int(index.budget[k]), len(index.texts[k])
        taken = -1
        for a, b in sorted(set(spans)):
            x, y = max(begin, a - e), min(end, b + size + e)
            got = align(index.texts[k], c[x:y].tobytes(), e)
            if got and x + got[1] >= taken:
                out.append((k, x + got[1], x + got[2], got[0]))
                taken = x + got[2]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end (byte offsets in the text), edits: one row per region."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    weight = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-2 * weight // BLOCK_BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, end long, edits int"
    found: DataFrame | None = None
    if blocks > 1:
        dealt = stored(dealt, "items")
    for b in range(blocks):
        rows = dealt.where(F.col("block") == b).orderBy("item_id").collect()
        made = Index.of([(r["item_id"], r["text"]) for r in rows], rate)
        shared = spark.sparkContext.broadcast(vars(made))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(**shared.value)
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for i, _, data, offs in pieces(batch.column(1)):
                    c, where, bounds = canonical(data, offs)
                    got = find(index, c, bounds)
                    if not got:
                        continue
                    rows_ = []
                    for d, k, x, y, edits in got:
                        spots = where[x:y]
                        spots = spots[spots >= 0]
                        rows_.append((ids[i + d], index.ids[k], int(spots[0] - offs[d]), int(spots[-1] + 1 - offs[d]), edits))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[n] for r in rows_], t)
                            for n, t in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()])
                        ],
                        names=["doc_id", "item_id", "start", "end", "edits"],
                    )

        part = plain.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found
