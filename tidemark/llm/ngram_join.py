"""Similarity self-join on word shingles by T-occurrence search.

Two texts link when ``100 * |A & B| >= percent * |A | B|`` over their sets of distinct
word shingles.  No link between different texts is lost:

1. *Routing.*  Sets are cut by hash into more segments than two linked sets can differ
   in, so linked sets agree on at least one non-empty segment.  The number of segments
   follows the size band; a set near the upper end of its band also takes part in the
   next one.  A set with more empty segments than the slack allows also sends the
   shingles of its prefix (the smallest hashes), which linked sets share in any case.
   Equal segments meet at the smallest set (by fingerprint) holding them, the anchor, so
   a group of g sets makes g rows and not g * g.
2. *Search.*  Around every anchor an inverted index over the members' shingles is
   searched by DivideSkip: the longest lists are set aside, the short ones are merged by
   a heap, sets that occur often enough are probed in the long lists by bisection and
   kept when they reach the overlap needed.  Members already connected are not probed.
   Large clusters are dealt into blocks, each with the anchor.
   A set is searched around the anchor it shares most with, and then compared with every
   other anchor it met.
3. *The rest.*  Where a member still is not connected with an anchor it met, it is searched
   against all blocks of that cluster, so pairs that no anchor bridges are found as well.
   Those that ask are dealt into blocks as well, and every pair of an asking and an index
   block is a group of its own: a group's size does not follow the cluster's.

Most sets that met do not link.  Before texts are copied to a group, its members' sketches
are: one parity bit for each of so many bins of shingles.  Two sketches differ in no more
bits than the sets differ in shingles, so members that differ too much from all others
(of step 3: from all that ask, or that are asked) are left out and no link is lost.

Equal sets are one node.  Empty or null texts link with nothing.  Repeated rows are
copies of each other.  Texts with fewer words than a shingle have one, their whole
sequence.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import by_group, components, discard, release, stored, stored_at, text_hash
from tidemark.llm.tokens import mix, pieces, runs, signed, word_bounds, words
from tidemark.session import join_checked, settle

BAND = 1.4
BLOCK_SHINGLES = 32_000  # shingles of a block in which all members ask each other
REST_SHINGLES = 256_000  # of one that is asked by those not connected: fewer copies of these
SKETCH_SHINGLES = 4_000_000  # of one of sketches, two or three bits a shingle
MU = 0.0085  # weight of the logarithm in DivideSkip's choice of long lists


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(runs(h, min(k, len(h))))


def fingerprints(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set."""
    a = mix(s + np.uint64(0x51ED270B))
    b = mix(s * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x2545F491))
    return int(signed(a.sum(keepdims=True))[0]), int(signed(b.sum(keepdims=True))[0])


def sketch(s: np.ndarray) -> bytes:
    """Parity of a set's shingles in each of 64 or more bins, 1.5 to 3 bins a shingle.

    Their number is a power of two, so the halves of a sketch folded by XOR are the sketch
    with half as many bins.
    """
    bins = 64
    while 2 * bins < 3 * len(s):
        bins *= 2
    at = (mix(s + np.uint64(0x2127599BF4325C37)) % np.uint64(bins)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bins) & 1).astype(np.uint8)).tobytes()


def possible(
    sizes: np.ndarray, sketches: list[bytes], comps: np.ndarray, asks: np.ndarray, percent: int
) -> np.ndarray:
    """Which members may link, by size and sketch, with one of another component; one of the two asks."""
    hit = np.zeros(len(sizes), bool)
    by_length: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable").tolist():
        by_length.setdefault(len(sketches[i]), []).append(i)
    bits = {n: np.frombuffer(b"".join(sketches[i] for i in m), np.uint64).reshape(len(m), -1) for n, m in by_length.items()}
    places = {n: np.array(m) for n, m in by_length.items()}

    def meet(askers: np.ndarray, theirs: np.ndarray, others: np.ndarray, index: np.ndarray) -> None:
        size, comp = sizes[others], comps[others]
        for q in np.flatnonzero(asks[askers]):
            me = askers[q]
            n = int(sizes[me])
            lo = np.searchsorted(size, -(-percent * n // 100), "left")
            hi = np.searchsorted(size, 100 * n // percent, "right")
            near = comp[lo:hi] != comps[me]
            if hit[me]:
                near &= ~hit[others[lo:hi]]
            near = np.flatnonzero(near) + lo
            if len(near):
                differ = np.bitwise_count(index[near] ^ theirs[q]).sum(axis=1, dtype=np.int64)
                near = near[(100 + percent) * differ <= (100 - percent) * (n + size[near])]
                hit[others[near]] = True
                hit[me] |= len(near) > 0

    for length, own in places.items():
        meet(own, bits[length], own, bits[length])
        if 2 * length in places:  # linked sets' sketches are of one length or of two neighbouring ones
            wide = bits[2 * length].reshape(len(places[2 * length]), 2, -1)
            folded = wide[:, 0] ^ wide[:, 1]
            meet(own, bits[length], places[2 * length], folded)
            meet(places[2 * length], folded, own, bits[length])
    return hit


def _band_start(j: int) -> int:
    return math.ceil(BAND**j - 1e-9)


def _band(n: int) -> int:
    j = int(math.log(n) / math.log(BAND))
    while _band_start(j + 1) <= n:
        j += 1
    while _band_start(j) > n:
        j -= 1
    return j


def _segments(j: int, percent: int) -> tuple[int, int]:
    """Number of segments of a band and how many of them may be empty."""
    largest = max(_band_start(j), _band_start(j + 1) - 1)
    differ = (100 - percent) * 2 * largest // (100 + percent)
    slack = 2 + differ // 20 if differ else 0
    return differ + 1 + slack, slack


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """Routing keys of one set: linked sets share at least one."""
    n = len(s)
    own = _band(n)
    bands = [own]
    if 100 * n // percent >= _band_start(own + 1):
        bands.append(own + 1)
    out = []
    for j in bands:
        m, slack = _segments(j, percent)
        tag = np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)
        seg = (mix(s + tag) % np.uint64(m)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, seg, mix(s ^ tag))
        full = np.bincount(seg, minlength=m) > 0
        out.append(mix(total[full] + np.flatnonzero(full).astype(np.uint64) * tag))
        if m - int(full.sum()) > slack:
            keep = n - -(-percent * n // 100) + 1
            out.append(mix((s[:keep] ^ ~tag)))
    return np.unique(np.concatenate(out))


def profiles(docs: DataFrame, k: int, percent: int, with_signatures: bool = True) -> DataFrame:
    """doc_id, text_hash, n_shingles, fp, fp2 and routing keys of every text."""
    schema = "doc_id long, text_hash long, n_shingles long, fp long, fp2 long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offs in pieces(batch.column(1)):
                h, start, _ = words(data, offs)
                at = word_bounds(start, offs)
                ns, f1, f2, keys = [], [], [], []
                for d in range(j - i):
                    s = shingle_set(h[at[d] : at[d + 1]], k)
                    a, b = fingerprints(s)
                    ns.append(len(s))
                    f1.append(a)
                    f2.append(b)
                    keys.append(signed(signatures(s, percent)) if len(s) and with_signatures else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i),
                        batch.column(2).slice(i, j - i),
                        pa.array(ns, pa.int64()),
                        pa.array(f1, pa.int64()),
                        pa.array(f2, pa.int64()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "fp", "fp2", "keys"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash()).mapInArrow(
        run, schema
    )


class Forest:
    """Union-find over component labels."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x] = root
            x = p
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _set_aside(lists: int, need: int, longest: int) -> int:
    """How many of the longest lists DivideSkip probes instead of merging."""
    return min(need - 1, int(need / (MU * math.log2(longest + 1) + 1)), lists)


def divide_skip(lists: list[list[int]], need: int) -> tuple[Iterator[tuple[int, int]], list[list[int]]]:
    """Split the lists and merge the short ones: ids with their counts, and the long lists.

    Only ids that could still reach ``need`` with the help of every long list come out.
    """
    lists = sorted(lists, key=len)
    aside = _set_aside(len(lists), need, len(lists[-1]) if lists else 1)
    short, long_ = lists[: len(lists) - aside], lists[len(lists) - aside :]
    merged = ((i, sum(1 for _ in g)) for i, g in groupby(heapq.merge(*short)))
    return ((i, c) for i, c in merged if c >= need - aside), long_


def search(sets: list[np.ndarray], comps: list[int], percent: int) -> list[tuple[int, int]]:
    """Links (positions) among all members that connect their components.

    Members come in by size and ask those before them; a pair whose components are
    already connected is not looked at.
    """
    known = _shared_only(sets, None, percent)
    order = sorted((i for i in range(len(sets)) if known[i][1]), key=lambda i: (known[i][0], i))
    forest, links = Forest(), []
    index: dict[int, list[int]] = {}
    for p, q in enumerate(order):
        n, own = known[q]
        need = _least_overlap(n, percent)
        lists = [x for s in own if (x := index.get(s))]
        if len(lists) >= need:
            found, long_ = divide_skip(lists, need)
            for c, count in sorted(found, key=lambda x: -x[1]):
                i = order[c]
                if forest.find(comps[i]) == forest.find(comps[q]):
                    continue
                m = known[i][0]
                wanted = -(-percent * (n + m) // (100 + percent))
                left = len(long_)
                for x in long_:
                    if count + left < wanted:
                        break
                    at = bisect_left(x, c)
                    count += at < len(x) and x[at] == c
                    left -= 1
                if 100 * count >= percent * (n + m - count):
                    links.append((q, i))
                    forest.join(comps[q], comps[i])
        for s in own:
            index.setdefault(s, []).append(p)
    return links


def _least_overlap(n: int, percent: int) -> int:
    """Overlap that a set of size ``n`` needs with the smallest set it can link with."""
    return -(-percent * (n + -(-percent * n // 100)) // (100 + percent))


def search_rest(
    sets: list[np.ndarray], comps: list[int], queries: list[int], percent: int
) -> list[tuple[int, int]]:
    """Links between the queries and all other members of other components.

    The same search over a finished index, for many members at once: all lists lie in one
    sorted array of (shingle, member); the short ones are merged by a sort in place of the
    heap, the long ones are probed by bisection for all members that are left.
    """
    known = _shared_only(sets, queries, percent)
    order = sorted((i for i in range(len(sets)) if known[i][1]), key=lambda i: (known[i][0], i))
    if len(order) < 2:
        return []
    size = np.array([known[i][0] for i in order])
    label = np.unique(np.array([comps[i] for i in order]), return_inverse=True)[1]
    total = len(order)
    code = np.concatenate([np.array(known[i][1], np.int64) for i in order])
    flat = code * total + np.repeat(np.arange(total), [len(known[i][1]) for i in order])
    flat.sort()
    begin = np.searchsorted(flat, np.arange(int(code.max()) + 2) * total)
    links = []
    asking = set(queries)
    for p, q in enumerate(order):
        if q not in asking:
            continue
        n, own = known[q]
        fits = (label != label[p]) & (100 * size >= percent * n) & (100 * n >= percent * size)
        if not fits.any():
            continue
        need = _least_overlap(n, percent)
        own_ = np.array(own, np.int64)
        length = begin[own_ + 1] - begin[own_]
        by_length = np.argsort(length, kind="stable")
        aside = _set_aside(len(own_), need, int(length.max()))
        # The short lists, merged by sorting; the long ones in order, for the probes.
        short, long_ = own_[by_length[: len(own_) - aside]], np.sort(own_[by_length[len(own_) - aside :]])
        many = begin[short + 1] - begin[short]
        at = np.repeat(begin[short] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        merged = flat[at] - np.repeat(short * total, many)
        ids, count = np.unique(merged[fits[merged]], return_counts=True)
        enough = count >= need - aside
        ids, count = ids[enough], count[enough]
        wanted = -(-percent * (n + size[ids]) // (100 + percent))
        left = aside
        for lo in range(0, aside, 64):
            if not len(ids):
                break
            part = long_[lo : lo + 64]
            probe = (part[:, None] * total + ids[None]).ravel()
            spot = np.minimum(np.searchsorted(flat, probe), len(flat) - 1)
            count = count + (flat[spot] == probe).reshape(len(part), len(ids)).sum(axis=0)
            left -= len(part)
            alive = count + left >= wanted
            ids, count, wanted = ids[alive], count[alive], wanted[alive]
        for i, k in zip(ids.tolist(), count.tolist()):
            if 100 * k >= percent * (n + int(size[i]) - k) and label[i] != label[p]:
                links.append((q, order[i]))
                label[label == label[i]] = label[p]
    return links


def _with_anchor(sets: list[np.ndarray], head: int, percent: int) -> list[tuple[int, int]]:
    """Links of one member with each of the others."""
    out = []
    for i, s in enumerate(sets):
        if i != head and len(s):
            n = int(np.isin(s, sets[head], assume_unique=True).sum())
            if 100 * n >= percent * (len(s) + len(sets[head]) - n):
                out.append((head, i))
    return out


def _shared_only(
    sets: list[np.ndarray], queries: list[int] | None, percent: int
) -> list[tuple[int, list[int]]]:
    """Size of each set and those of its shingles that can matter: numbered, in any order.

    A shingle that no other member (and no query) has is in no overlap.  A member with
    fewer than ``percent`` of its own shingles left can link with nobody and gets none;
    that takes shingles from others, so it is repeated until nothing changes.
    """
    sizes = np.array([len(s) for s in sets])
    if not len(sizes) or not sizes.sum():
        return [(int(n), []) for n in sizes]
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    asking = np.ones(len(sets), bool)
    if queries is not None:
        asking[:] = False
        asking[queries] = True
    while True:
        count = np.bincount(code)
        asked = np.bincount(code, weights=asking[owner]) > 0
        useful = (count >= 2)[code] & asked[code]
        left = np.bincount(owner[useful], minlength=len(sets))
        fits = 100 * left >= percent * sizes
        keep = useful & fits[owner]
        if keep.all() or not keep.any():
            break
        code, owner = code[keep], owner[keep]
    code, owner = code[keep], owner[keep]
    cuts = np.searchsorted(owner, np.arange(len(sets) + 1))
    return [(int(n), code[a:b].tolist()) for n, a, b in zip(sizes, cuts, cuts[1:])]


def _sets(texts: pd.Series, k: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offs in pieces(pa.array(texts, pa.string())):
        h, start, _ = words(data, offs)
        at = word_bounds(start, offs)
        out += [shingle_set(h[a:b], k) for a, b in zip(at, at[1:])]
    return out


def sketched(rows: DataFrame, k: int) -> DataFrame:
    """fp, text, n_text (its hash), size of the set and sketch of every row (asked, text); asked stays."""
    schema = "asked long, fp long, text string, n_text long, size long, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in pieces(batch.column(1)):
                h, start, _ = words(data, offs)
                at = word_bounds(start, offs)
                sets = [shingle_set(h[a:b], k) for a, b in zip(at, at[1:])]
                text = batch.column(1).slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([fingerprints(s)[0] for s in sets], pa.int64()),
                        text,
                        pa.array([hash(t) for t in text.to_pylist()], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([sketch(s) for s in sets], pa.binary()),
                    ],
                    names=["asked", "fp", "text", "n_text", "size", "sketch"],
                )

    return rows.select("asked", "text").mapInArrow(run, schema)


def may_link(rows: DataFrame, texts: DataFrame, percent: int, how: str) -> DataFrame:
    """Those of ``rows`` (see ``_links``) that by the sketches may have a link in their group."""
    names = ["anchor", "block", "fp", "comp", "asks"]

    def run(key: tuple, part: pd.DataFrame) -> list[tuple]:
        asks = part["fp"] == key[0] if how == "anchor" else part["asks"]
        hit = possible(
            part["size"].to_numpy(), part["sketch"].tolist(), part["comp"].to_numpy(), asks.to_numpy(bool), percent
        )
        return list(part.loc[hit, names].drop_duplicates().itertuples(index=False, name=None))

    joined = rows.join(texts.select("fp", "size", "sketch"), "fp")
    return by_group(joined, ["anchor", "block"], run, "anchor long, block long, fp long, comp long, asks boolean")


def _links(rows: DataFrame, texts: DataFrame, k: int, percent: int, how: str) -> DataFrame:
    """Search every (anchor, block) group of ``rows`` (anchor, block, fp, comp, asks).

    ``how``: "all" among all members, "anchor" with the anchor only, "rest" those that ask
    against all.
    """

    def run(key: tuple, part: pd.DataFrame) -> list[tuple]:
        part = part.drop_duplicates(["fp", "n_text"])
        sets = _sets(part["text"], k)
        comps, fps = part["comp"].tolist(), part["fp"].tolist()
        asks = part["asks"].tolist()
        if how == "all":
            found = search(sets, comps, percent)
        elif how == "anchor":
            heads = [i for i, f in enumerate(fps) if f == key[0]]
            found = [x for h in heads for x in _with_anchor(sets, h, percent)]
        else:
            found = search_rest(sets, comps, [i for i, x in enumerate(asks) if x], percent)
        return [(fps[a], fps[b]) for a, b in found]

    joined = join_checked(texts.select("fp", "text", "n_text"), settle(rows), ["fp"], even=True)
    return by_group(joined, ["anchor", "block"], run, "a long, b long")


def _links_in_turns(rows: DataFrame, texts: DataFrame, k: int, percent: int, how: str) -> DataFrame:
    """``_links`` of all groups, in as many turns as a text has copies on average.

    A text is shuffled to every group it is in; a turn's copies are deleted before the next
    turn's are written, so about one copy of each text is on disk at a time.
    """
    spark = rows.sparkSession
    kept, kept_at = stored_at(rows, "ngram-asked")
    turns = max(1, math.ceil(kept.count() / max(1, texts.count())))
    found = []
    for turn in range(turns):
        own = kept.where(F.pmod(F.xxhash64("anchor", "block"), F.lit(turns)) == turn)
        found.append(stored(_links(own, texts, k, percent, how), f"ngram-{how}"))
        release(spark)
    discard(spark, kept_at)
    return reduce(DataFrame.union, found)


def _blocks(rows: DataFrame, sizes: DataFrame, shingles: int) -> DataFrame:
    """Number of blocks of every anchor's cluster, from its members' shingles."""
    return (
        rows.join(sizes, "fp")
        .groupBy("anchor")
        .agg(F.ceil(F.sum("n_shingles") / shingles).cast("int").alias("blocks"))
    )


def rest_groups(everyone: DataFrame, asking: DataFrame, sizes: DataFrame, shingles: int) -> DataFrame:
    """Rows (anchor, block, fp, comp, asks) of the last search: a block is a pair of blocks.

    ``everyone`` are the members (anchor, fp, comp) of the clusters, ``asking`` those of
    them that ask.  Every asking member meets every other in one group, and a group holds
    about ``shingles`` of either side.
    """
    askers = _blocks(asking, sizes, shingles).withColumnRenamed("blocks", "ask_blocks")
    pairs = settle(stored(_blocks(everyone, sizes, shingles).join(askers, "anchor"), "ngram-blocks"))

    def dealt(rows: DataFrame, own: str, other: str, block: Column, asks: bool) -> DataFrame:
        spread = join_checked(rows, pairs, ["anchor"]).withColumns(
            {
                "own": F.pmod(F.xxhash64("fp"), F.col(own)).cast("long"),
                "other": F.explode(F.sequence(F.lit(0).cast("long"), F.col(other).cast("long") - 1)),
            }
        )
        return spread.select("anchor", block.alias("block"), "fp", "comp", F.lit(asks).alias("asks"))

    place = lambda ask, index: F.col(ask) * F.col("blocks") + F.col(index)
    index = dealt(everyone, "blocks", "ask_blocks", place("other", "own"), False)
    askers_ = dealt(asking, "ask_blocks", "blocks", place("own", "other"), True)
    return index.union(askers_).groupBy("anchor", "block", "fp", "comp").agg(F.max("asks").alias("asks"))


def _routed(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Profiles of all texts without their keys, and edges (fp, anchor, shared) between sets that met."""
    routed, routed_at = stored_at(profiles(docs, k, percent), "ngram-routing")
    profile = stored(routed.drop("keys"), "ngram-profile")
    # Keys are dealt out once: the smallest set of a key and the others that have it are looked up
    # there.  The join would ask for keys that are not null below the exchange and so get one of
    # its own; asked for beforehand, both read the same.
    keys = routed.select("fp", F.explode("keys").alias("key")).where("key is not null and fp is not null").repartition("key")
    meets = (
        keys.groupBy("key")
        .agg(F.min("fp").alias("anchor"), F.max("fp").alias("last"))
        .where("anchor < last")
        .select("key", "anchor")
    )
    edges = stored(
        keys.join(meets, "key")
        .where("fp <> anchor")
        .groupBy("fp", "anchor")
        .agg(F.count("*").alias("shared")),
        "ngram-edges",
    )
    discard(docs.sparkSession, routed_at)  # most keys belong to one set only
    return profile, edges


def similar_components(docs: DataFrame, k: int = 4, percent: int = 85, rows: bool = False) -> DataFrame:
    """One row per text: doc_id, n_shingles, component_id (smallest doc_id reachable).

    ``rows`` adds text_hash and part, a number of the component that does not hang on ids:
    ids that several texts share or that are null tell neither rows nor components apart.

    Texts without words have n_shingles 0 and are alone; null doc_ids stay null and
    count as larger than any other.
    """
    profile, edges = _routed(docs, k, percent)
    release(docs.sparkSession)  # of the keys' exchange, the largest of all
    classes = (
        profile.where("n_shingles > 0")
        .groupBy("fp", "fp2")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"))
    )
    nodes = edges.select("fp").union(edges.select("anchor")).distinct()
    needed = stored(classes.join(nodes, "fp").select("fp", "rep", "n_shingles"), "ngram-nodes")
    wanted = needed.select(F.col("rep").alias("doc_id"), "fp")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # A doc_id may be on several rows: the text that has the fingerprint is the one meant.
    found = join_checked(plain, settle(wanted), ["doc_id"], even=True)

    texts = sketched(found.withColumnRenamed("fp", "asked"), k).where("fp = asked").drop("asked")
    lost = needed.where("rep is null").select("fp")
    if lost.limit(1).count():  # texts that only rows without an id have are known by their fingerprint alone
        unnamed = plain.where("doc_id is null and text is not null").withColumn("asked", F.lit(None).cast("long"))
        more = join_checked(sketched(unnamed, k), settle(lost), ["fp"], even=True)
        texts = texts.union(more.select(*texts.columns).dropDuplicates(["fp"]))
    texts, texts_at = stored_at(texts, "ngram-texts")
    sizes = needed.select("fp", "n_shingles")

    def dealt(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        return join_checked(rows, settle(blocks), ["anchor"]).withColumn("block", block).drop("blocks")

    def with_heads(rows: DataFrame) -> DataFrame:
        """Members (anchor, block, fp) and the anchor itself in every block."""
        heads = rows.select("anchor", "block").distinct().withColumn("fp", F.col("anchor"))
        both = rows.select("anchor", "block", "fp").union(heads)
        return both.withColumns({"comp": F.col("fp"), "asks": F.lit(True)})

    def labelled(df: DataFrame, on: str, name: str) -> DataFrame:
        own = labels.select(F.col("node").alias(on), F.col("label").alias(name))
        return df.join(own, on, "left").withColumn(name, F.coalesce(name, on))

    def opened() -> DataFrame:
        """Edges whose ends are in different components as yet."""
        known = labelled(labelled(edges.select("fp", "anchor"), "fp", "comp"), "anchor", "home")
        return stored(known.where("comp <> home"), "ngram-open")

    def linked(rows: DataFrame, how: str) -> DataFrame:
        return _links_in_turns(may_link(rows, texts, percent, how), texts, k, percent, how)

    # First every set with the anchor it shares most with, and that anchor's other sets.
    best = edges.groupBy("fp").agg(F.max_by("anchor", F.struct("shared", -F.col("anchor"))).alias("anchor"))
    members = dealt(best, _blocks(best, sizes, BLOCK_SHINGLES))
    links = linked(with_heads(members), "all")
    labels = components(links)

    # Then with every other anchor it met.
    release(docs.sparkSession)
    open_ = opened()
    members = dealt(open_.select("anchor", "fp"), _blocks(open_, sizes, REST_SHINGLES))
    links = links.union(linked(with_heads(members), "anchor"))
    labels = components(links)

    # What no anchor bridges is searched against whole clusters.
    release(docs.sparkSession)
    open_ = opened()
    if open_.limit(1).count():
        clusters = open_.select("anchor").distinct()
        inside = labelled(labelled(edges.join(clusters, "anchor", "left_semi").select("anchor", "fp"), "fp", "comp"), "anchor", "home")
        everyone = inside.select("anchor", "fp", "comp").union(
            inside.select("anchor", F.col("anchor").alias("fp"), F.col("home").alias("comp")).distinct()
        )
        met = may_link(rest_groups(everyone, open_.select("anchor", "fp", "comp"), sizes, SKETCH_SHINGLES), texts, percent, "rest")
        near = stored(met.groupBy("anchor", "fp", "comp").agg(F.max("asks").alias("asks")), "ngram-near")
        rest = rest_groups(near.drop("asks"), near.where("asks").drop("asks"), sizes, REST_SHINGLES)
        more = _links_in_turns(rest, texts, k, percent, "rest")
        if more.limit(1).count():
            labels = components(links.union(more))
    discard(docs.sparkSession, texts_at)
    named = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    lows = named.where("label is not null").groupBy("label").agg(F.min("rep").alias("low"))
    component = named.join(lows, "label", "left").select(
        "fp", "fp2", F.coalesce("low", "rep").alias("component_id"), F.coalesce("label", "fp").alias("part")
    )
    full = profile.select("doc_id", "text_hash", "n_shingles", "fp", "fp2")
    return full.join(component, ["fp", "fp2"], "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        *(["text_hash", "part"] if rows else []),
    )
