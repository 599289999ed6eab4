"""A SentencePiece BPE model: its file, its character map, its merges.

``read_model`` turns the file into plain tables that travel to the tasks.  ``Normalizer``
rewrites text by the longest rule of the compiled character map at each place and records
for every byte of the result the source byte it came from; ``Merger`` turns a stretch of
normalised text into ids with the length of each piece, so spans follow by running sums.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE_MARK = "▁"
_MARK = SPACE_MARK.encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
_REPLACEMENT = "�".encode()
EMPTY = np.zeros((0, 2), "<u4")


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of an encoded protocol message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, message[at : at + size]
        at += size


@dataclass(frozen=True)
class PieceModel:
    """What encoding and decoding need of a model file."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unknown: int
    begin: int
    end: int
    unknown_surface: str
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    squeeze: bool  # white space at the ends and after white space goes
    escape: bool


def read_model(data: bytes) -> PieceModel:
    """Tables of a model file.  Only BPE models without a denormaliser are known."""
    pieces, scores, kinds = [], [], []
    specs: dict[int, dict[int, int | bytes]] = {2: {}, 3: {}, 5: {}}
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = b"", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            pieces.append(piece.decode())
            scores.append(score)
            kinds.append(kind)
        elif number in specs:
            specs[number].update(fields(value))
    trainer, normal, back = specs[2], specs[3], specs[5]
    if trainer.get(3, 1) != BPE:
        raise ValueError("only BPE models are supported")
    if back.get(2) or trainer.get(24):
        raise ValueError("models with a denormaliser or white space as suffix are not supported")

    def control(number: int, default: str) -> int:
        name = trainer.get(number, default.encode()).decode()
        return pieces.index(name) if name in pieces else -1

    return PieceModel(
        pieces,
        scores,
        kinds,
        kinds.index(UNKNOWN),
        control(46, "<s>"),
        control(47, "</s>"),
        trainer.get(44, b" \xe2\x81\x87 ").decode(),
        bool(trainer.get(35, 0)),
        normal.get(2, b""),
        bool(normal.get(3, 1)),
        bool(normal.get(4, 1)),
        bool(normal.get(5, 1)),
    )


class CharMap:
    """Rules of a compiled character map: a double-array trie and the texts it points into."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest rule at a place (0: none) and what it becomes."""
        units = self.units
        node = _offset(units[0])
        length, value = 0, -1
        for i in range(at, len(data)):
            b = data[i]
            node ^= b
            unit = units[node]
            if unit & 0x800000FF != b:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                length, value = i + 1 - at, units[node] & 0x7FFFFFFF
        if not length:
            return 0, b""
        return length, self.texts[value : self.texts.index(b"\0", value)]

    def first_bytes(self) -> set[int]:
        if not self.units:
            return set()
        root = _offset(self.units[0])
        return {b for b in range(1, 256) if self.units[root ^ b] & 0x800000FF == b}


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 512) >> 6)


def _char_size(data: bytes, at: int) -> int:
    """Bytes of the valid UTF-8 character at a place; 0 if there is none."""
    b = data[at]
    size = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    try:
        return size if size and len(data[at : at + size].decode()) == 1 else 0
    except UnicodeDecodeError:
        return 0


class Normalizer:
    """Normalised bytes of a text, and the source byte of each of them."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.map = CharMap(model.charsmap)
        users = [p.encode() for p, k in zip(model.pieces, model.kinds) if k == USER_DEFINED]
        self.users = re.compile(b"|".join(map(re.escape, sorted(users, key=len, reverse=True)))) if users else None
        starts = self.map.first_bytes() | {u[0] for u in users}
        self.plain = not starts and not model.squeeze
        # Stretches of ASCII characters that no rule begins with are copied as they are.
        dull = [b for b in range(128) if b not in starts and b != 32]
        self.dull = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in dull) + b"]+") if dull else None

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            try:
                text.decode()
                return self._copied(text)
            except UnicodeDecodeError:
                pass
        return self._ruled(text)

    def _copied(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without rules only spaces change."""
        mark = _MARK if self.model.escape else b" "
        head = mark if self.model.dummy_prefix else b""
        size = np.where(np.frombuffer(text, np.uint8) == 32, len(mark), 1)
        source = np.repeat(np.arange(len(text)), size)
        source = np.concatenate((np.zeros(len(head), np.int64), source, [len(text)]))
        return head + text.replace(b" ", mark), source

    def _steps(self, text: bytes) -> Iterator[tuple[bytes, int, int, bool]]:
        """(what it becomes, start, end, copied byte by byte) of each stretch of the text."""
        at = 0
        while at < len(text):
            if self.dull and (m := self.dull.match(text, at)):
                yield m.group(), at, m.end(), True
                at = m.end()
                continue
            if self.users and (m := self.users.match(text, at)):
                yield m.group(), at, m.end(), False
                at = m.end()
                continue
            size, became = self.map.longest(text, at) if self.map.units else (0, b"")
            if not size:
                size = _char_size(text, at)
                became = text[at : at + size] if size else _REPLACEMENT
                size = size or 1
            yield became, at, at + size, False
            at += size

    def _ruled(self, text: bytes) -> tuple[bytes, np.ndarray]:
        model = self.model
        mark = _MARK if model.escape else b" "
        out: list[bytes] = []
        source: list[np.ndarray] = []

        def put(part: bytes, at: int, each: bool) -> None:
            spaced = part.replace(b" ", mark)
            source.append(np.arange(at, at + len(part)) if each else np.full(len(spaced), at))
            out.append(spaced)

        steps = self._steps(text)
        first = next(steps, None)
        if model.squeeze:
            while first and first[0] == b" ":
                first = next(steps, None)
        if first is None:
            return b"", np.zeros(1, np.int64)
        if model.dummy_prefix:
            put(b" ", first[1], False)
        after_space, end = model.squeeze, first[1]
        step: tuple[bytes, int, int, bool] | None = first
        while step:
            part, at, end, each = step
            if after_space:
                part = part.lstrip(b" ")
            if part:
                put(part, at, each)
                after_space = part.endswith(b" ")
            if not model.squeeze:
                after_space = False
            step = next(steps, None)
        made, places = b"".join(out), np.concatenate(source)
        if model.squeeze:
            while made.endswith(mark):
                made = made[: -len(mark)]
                end = int(places[len(made)])
        return made, np.append(places[: len(made)], end)


class Memo(dict):
    """Results of a function by its argument; emptied when full, long arguments are not kept."""

    def __init__(self, fn: Callable[[str], bytes], entries: int, longest: int):
        super().__init__()
        self.fn, self.entries, self.longest = fn, entries, longest

    def __missing__(self, key: str) -> bytes:
        found = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[key] = found
        return found


class Merger:
    """Ids of stretches of normalised text.

    A stretch may be cut between two characters that no piece holds next to each other: no
    merge crosses such a place.  Texts are cut before space marks, as far as that holds for
    the character before, and stretches that are new once more at every such pair.  Both
    kinds are worked out once and looked up after that.
    """

    WORDS, STEMS, LONG = 50_000, 200_000, 100  # entries of the memos: about 60 MB
    SHORT = 64  # characters up to which a plain search for the next merge beats a heap

    def __init__(self, model: PieceModel):
        self.model = model
        usable = (NORMAL, USER_DEFINED, UNUSED)
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in usable}
        order = {s: n for n, s in enumerate(sorted({model.scores[i] for i in self.ids.values()}, reverse=True))}
        self.rank = {p: order[model.scores[i]] for p, i in self.ids.items() if len(p) > 1}
        self.never = len(order)
        users = [p for p, k in zip(model.pieces, model.kinds) if k == USER_DEFINED]
        self.users = re.compile("|".join(map(re.escape, sorted(users, key=len, reverse=True)))) if users else None
        self.simple = not users and UNUSED not in model.kinds
        self.packed = {p: struct.pack("<2I", i, len(p.encode())) for p, i in self.ids.items()}
        self.byte_ids = {
            int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE
        }
        self.pairs = {p[n : n + 2] for p in self.ids for n in range(len(p) - 1)}
        crossing = sorted({p[0] for p in self.pairs if p[1] == SPACE_MARK and p[0] != SPACE_MARK})
        self.at_marks = not crossing
        self.cut = re.compile(self._pattern(crossing))
        self.stretches = Memo(self.divided, self.WORDS, self.LONG)
        self.stems = Memo(self.merged, self.STEMS, self.LONG)

    @staticmethod
    def _pattern(crossing: list[str]) -> str:
        """Pattern of stretches cut before marks; a mark after one of ``crossing`` is no place to cut."""
        if not crossing:
            return f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+"
        inner = "".join(f"(?:{re.escape(c)}{SPACE_MARK}+)|" for c in crossing)
        return f"{SPACE_MARK}*(?:{inner}[^{SPACE_MARK}])+|{SPACE_MARK}+"

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Rows (id, bytes of normalised text) of the pieces of each text.

        The words of all texts that have single marks are numbered by Arrow, so each
        different word is looked up once.
        """
        out: list[np.ndarray] = [EMPTY] * len(texts)
        plain = []
        for n, t in enumerate(texts):
            if self.at_marks and t.startswith(SPACE_MARK) and not t.endswith(SPACE_MARK) and SPACE_MARK * 2 not in t:
                plain.append(n)
            elif t:
                out[n] = np.frombuffer(b"".join(map(self.stretches.__getitem__, self.cut.findall(t))), "<u4").reshape(-1, 2)
        if plain:
            split = pc.split_pattern(pa.array([texts[n][1:] for n in plain], pa.large_string()), SPACE_MARK)
            coded = split.flatten().dictionary_encode()
            packed = [self.stretches[SPACE_MARK + w] for w in coded.dictionary.to_pylist()]
            flat = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 2)
            many = np.array([len(x) for x in packed]) // 8
            first = np.cumsum(many) - many
            word = coded.indices.to_numpy()
            count = many[word]
            stop = np.cumsum(count)
            rows = flat[np.repeat(first[word] - (stop - count), count) + np.arange(int(stop[-1]))]
            ends = stop[split.offsets.to_numpy()[1:] - 1].tolist()
            for n, a, b in zip(plain, [0, *ends], ends):
                out[n] = rows[a:b]
        return out if self.model.byte_fallback else [self._joined(x) for x in out]

    def _joined(self, found: np.ndarray) -> np.ndarray:
        """Neighbours without a piece are one unknown piece."""
        if not len(found):
            return found
        lost = found[:, 0] == self.model.unknown
        heads = np.flatnonzero(~(lost & np.concatenate(([False], lost[:-1]))))
        return np.stack((found[heads, 0], np.add.reduceat(found[:, 1], heads)), axis=1).astype("<u4")

    def divided(self, part: str) -> bytes:
        """A stretch cut once more, between characters that are nowhere neighbours in a piece."""
        pairs, stems = self.pairs, self.stems
        cuts = [n for n, (a, b) in enumerate(zip(part, part[1:]), 1) if a + b not in pairs]
        if not cuts:
            return stems[part]
        return b"".join([stems[part[a:b]] for a, b in zip([0, *cuts], [*cuts, len(part)])])

    def merged(self, part: str) -> bytes:
        found, packed = [], self.packed
        pieces = self.quick(part) if self.simple and len(part) <= self.SHORT else self.pieces(part)
        try:
            return b"".join([packed[p] for p in pieces])
        except KeyError:
            pass
        for piece in pieces:
            known = packed.get(piece)
            if known is not None:
                found.append(known)
                continue
            raw = piece.encode()
            if self.model.byte_fallback:
                # Only the last byte carries the character's span.
                found += [struct.pack("<2I", self.byte_ids[b], 0) for b in raw[:-1]]
                found.append(struct.pack("<2I", self.byte_ids[raw[-1]], len(raw)))
            else:
                found.append(struct.pack("<2I", self.model.unknown, len(raw)))
        return b"".join(found)

    def quick(self, part: str) -> list[str]:
        """``pieces`` of a short stretch: the best neighbours, leftmost first, are looked for anew."""
        get, never = self.rank.get, self.never
        symbols = list(part)
        ranks = [get(a + b, never) for a, b in zip(part, part[1:])]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            n = ranks.index(best)
            symbols[n] = both = symbols[n] + symbols[n + 1]
            del symbols[n + 1], ranks[n]
            if n:
                ranks[n - 1] = get(symbols[n - 1] + both, never)
            if n < len(ranks):
                ranks[n] = get(both + symbols[n + 1], never)
        return symbols

    def _symbols(self, part: str) -> tuple[list[str], list[bool]]:
        """Characters, and user-defined pieces, which take part in no merge."""
        if not self.users:
            return list(part), []
        symbols, fixed, at = [], [], 0
        while at < len(part):
            m = self.users.match(part, at)
            symbols.append(m.group() if m else part[at])
            fixed.append(bool(m))
            at += len(symbols[-1])
        return symbols, fixed

    def pieces(self, part: str) -> list[str]:
        """Merge neighbours, the best score first and of equal ones the leftmost."""
        symbols, fixed = self._symbols(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        ids, scores, kinds = self.ids, self.model.scores, self.model.kinds
        agenda: list[tuple[float, int, int, str]] = []
        split: dict[str, tuple[str, str]] = {}

        def offer(a: int, b: int) -> None:
            if a < 0 or b < 0 or (fixed and (fixed[a] or fixed[b])):
                return
            both = symbols[a] + symbols[b]
            i = ids.get(both)
            if i is not None:
                heapq.heappush(agenda, (-scores[i], a, b, both))
                if kinds[i] == UNUSED:
                    split[both] = (symbols[a], symbols[b])

        for a in range(n - 1):
            offer(a, a + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if not symbols[a] or not symbols[b] or symbols[a] + symbols[b] != both or after[a] != b:
                continue
            symbols[a], symbols[b] = both, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out = [s for s in symbols if s]
        if not split:
            return out
        done: list[str] = []
        for s in out:  # pieces that only serve as steps come apart again
            todo = [s]
            while todo:
                x = todo.pop()
                i = ids.get(x)
                if i is not None and kinds[i] == UNUSED and x in split:
                    todo += reversed(split[x])
                else:
                    done.append(x)
        return done


class Decoder:
    """Text of a row of ids."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.surface: list[bytes] = []
        for p, k in zip(model.pieces, model.kinds):
            if k == CONTROL:
                s = ""
            elif k == UNKNOWN:
                s = model.unknown_surface
            elif k == BYTE:
                self.surface.append(bytes([int(p[3:5], 16)]))
                continue
            else:
                s = p.replace(SPACE_MARK, " ")
            self.surface.append(s.encode())

    def __call__(self, ids: list[int]) -> str:
        kinds, surface = self.model.kinds, self.surface
        strip = self.model.dummy_prefix or self.model.squeeze
        # A leading mark goes: of the first piece that has text, or of all as long as nothing but marks came.
        head, at = b"", 0
        while strip and at < len(ids) and not head:
            i = ids[at]
            if kinds[i] == BYTE:
                break
            own = surface[i]
            at += 1
            if kinds[i] in (CONTROL, UNKNOWN):
                head += own
            elif own.startswith(b" "):
                head += own[1:]
                if not self.model.squeeze:
                    break
            else:
                head += own
        rest = ids[at:]
        try:
            return (head + b"".join([surface[i] for i in rest])).decode()
        except UnicodeDecodeError:
            return head.decode() + self._mended(rest)

    def _mended(self, ids: list[int]) -> str:
        """Bytes that are no character become the replacement character, one by one."""
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.model.kinds[i] == BYTE:
                run += self.surface[i]
                continue
            at = 0
            while at < len(run):
                size = _char_size(run, at)
                out.append(run[at : at + size] if size else _REPLACEMENT)
                at += size or 1
            run = b""
            if i is not None:
                out.append(self.surface[i])
        return b"".join(out).decode()
