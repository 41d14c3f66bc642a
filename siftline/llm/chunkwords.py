"""Encoding texts through a memory of their chunks, with numpy only.

The pre-tokenizing pattern of byte-level BPE ends a match in two places that bytes
alone tell: before a space that a non-space character follows (white space before
it ends its own match, and the space joins what follows), and between an ASCII
letter and an ASCII mark. Texts are cut there, the chunks encoded on their own and
their ids joined, with the same result. Chunks repeat a lot, so each worker
remembers the ids of many of them, under two 64-bit hashes that both must agree.
Where another pattern is given, a chunk is a whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .textbytes import chunks, mix

#: The pattern whose matches the cuts respect (fixed value: the public one of byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks that a worker remembers.
MEMORY = 1_000_000
#: Longer chunks are encoded each time and not remembered.
LONG = 64
#: Newly met chunks are merged into the sorted memory once there are so many.
YOUNG = 100_000
#: Bytes of text that are cut at once, but for a longer text.
BATCH = 3 << 19
_U = np.uint64
_LETTER, _MARK, _BLANK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: What may be white space behind a space: ASCII controls and the first bytes of wider white space.
_BLANK[[*range(33), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_CODES = [mix(np.arange(1, 257, dtype=_U) * _U(m)) | _U(1) for m in (0xD1342543DE82EF95, 0xA24BAED4963EE407)]
_BASE = (0x9E3779B97F4A7C15 | 3, 0xD6E8FEB86659FD93 | 3)
_POWERS: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
_MADE: dict[str, Encoder] = {}

#: Function of the bytes of chunks laid end to end, their ends, and which of them open with a space, to (ids, number of ids of each).
EncodeChunks = Callable[[bytes, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts that lie end to end."""
    n = len(buf)
    at = np.zeros(n + 1, bool)
    at[:-2] = (buf[:-1] == 0x20) & ~_BLANK[buf[1:]]
    at[np.maximum(off[1:] - 1, 0)] = False  # a space that ends a text
    at[1:n] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
    at[off] = True
    return np.flatnonzero(at[:n])


def parts(buf: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about BATCH bytes, cut where a chunk begins."""
    lo, size = 0, BATCH
    while lo < len(buf):
        part = buf[lo : lo + size]
        at = len(part) if lo + size >= len(buf) else int(cuts(part, np.array([0, len(part)]))[-1])
        if at:
            yield part[:at]
            lo, size = lo + at, BATCH
        else:
            size *= 2


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    have = next(iter(_POWERS), 0)
    if have < n:
        size = max(n, BATCH)
        own = []
        for p in _BASE:
            up, down = np.full(size, p, _U), np.full(size, pow(p, -1, 1 << 64), _U)
            up[0] = down[0] = 1
            own.append((np.multiply.accumulate(up), np.multiply.accumulate(down)))
        _POWERS.clear()
        _POWERS[size] = own
    return next(iter(_POWERS.values()))


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each span of bytes, from running sums."""
    out = []
    for code, (up, down) in zip(_CODES, _powers(len(buf)), strict=True):
        total = np.zeros(len(buf) + 1, _U)
        np.cumsum(code[buf] * up[: len(buf)], out=total[1:])
        out.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(_U)))
    return out[0], out[1]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of spans laid end to end."""
    shift = start - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else start
    return np.repeat(shift, size) + np.arange(int(size.sum()))


class _Sorted:
    """Ids of chunks, found by the first of their two hashes."""

    def __init__(self):
        self.h, self.g = np.zeros(0, _U), np.zeros(0, _U)
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The place of each, -1 where it isn't known."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where((self.h[at] == h) & (self.g[at] == g), at, -1)

    def merged(self, h: np.ndarray, g: np.ndarray, size: np.ndarray, flat: np.ndarray) -> _Sorted:
        """With further chunks; of two with one first hash the older stays."""
        new, out = np.ones(len(h), bool), _Sorted()
        if len(self.h):
            new = self.h[np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)] != h
        keys = np.concatenate([self.h, h[new]])
        order = np.argsort(keys, kind="stable")
        start = np.concatenate([[0], np.cumsum(size)])[:-1] + len(self.flat)
        out.h, out.g = keys[order], np.concatenate([self.g, g[new]])[order]
        out.start, out.size = np.concatenate([self.start, start[new]])[order], np.concatenate([self.size, size[new]])[order]
        out.flat = np.concatenate([self.flat, flat])
        return out


class Memory:
    """The ids of up to about `most` chunks: a large sorted table and a small one of what came last. When it is full it starts again from the small one."""

    def __init__(self, most: int = MEMORY):
        self.most, self.old, self.young = most, _Sorted(), _Sorted()

    def find(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether known, number of ids, all ids of the known ones end to end)."""
        a, b = self.old.find(h, g), self.young.find(h, g)
        size, start = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for at, own, base in ((a, self.old, 0), (b, self.young, len(self.old.flat))):
            has = at >= 0
            size[has], start[has] = own.size[at[has]], own.start[at[has]] + base
        known = (a >= 0) | (b >= 0)
        flat = np.concatenate([self.old.flat, self.young.flat])
        return known, size, flat[_spread(start[known], size[known])]

    def put(self, h: np.ndarray, g: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        self.young = self.young.merged(h, g, size, flat)
        if len(self.young.h) > min(YOUNG, self.most):
            full = len(self.old.h) + len(self.young.h) > self.most
            young, self.young = self.young, _Sorted()
            self.old = young if full else self.old.merged(young.h, young.g, young.size, young.flat[_spread(young.start, young.size)])


class Encoder:
    """Encodes texts with encode_chunks, which must give the ids of each chunk as if it stood in its text. whole: texts aren't cut."""

    def __init__(self, encode_chunks: EncodeChunks, whole: bool = False, memory: int = MEMORY):
        self.encode_chunks, self.whole, self.memory = encode_chunks, whole, Memory(memory)

    @staticmethod
    def of(name: str, make: Callable[[], Encoder]) -> Encoder:
        """This process's encoder of that name; an earlier one's memory is let go."""
        if name not in _MADE:
            _MADE.clear()
            _MADE[name] = make()
        return _MADE[name]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        for lo, hi, buf, off in chunks(texts, BATCH):
            if hi - lo > 1 or self.whole or len(buf) < 2 * BATCH:
                yield from self._batch(buf, off)
            else:
                yield np.concatenate([self._batch(part, np.array([0, len(part)]))[0] for part in parts(buf)])

    def _batch(self, buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        if not len(buf):
            return [np.zeros(0, np.uint32)] * (len(off) - 1)
        start = np.unique(off[:-1][off[:-1] < off[1:]]) if self.whole else cuts(buf, off)
        end = np.append(start[1:], len(buf))
        h, g = hashes(buf, start, end)
        _, first, code = np.unique(h, return_index=True, return_inverse=True)
        if (g != g[first[code]]).any():  # two chunks share one hash: none is taken for the other
            first, code = np.arange(len(h)), np.arange(len(h))
        known, size, ids = self.memory.find(h[first], g[first])
        new = first[~known]
        long_ = end[new] - start[new]
        data = buf[_spread(start[new], long_)].tobytes()
        opens = (buf[start[new]] == 0x20) & (long_ > 1) & ~_BLANK[buf[np.minimum(start[new] + 1, len(buf) - 1)]] & (not self.whole)
        made, count = self.encode_chunks(data, np.cumsum(long_), opens)
        short = long_ < LONG
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        order = np.argsort(h[new][short], kind="stable")
        self.memory.put(h[new][short][order], g[new][short][order], count[short][order], made[_spread(begin[short][order], count[short][order])])
        place = np.zeros(len(first), np.int64)
        place[known] = np.concatenate([[0], np.cumsum(size[known])])[:-1]
        place[~known] = begin + len(ids)
        size[~known] = count
        n = size[code]
        out = np.concatenate([ids, made])[_spread(place[code], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        at = total[np.searchsorted(start, off)]
        return [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def groups(ends: np.ndarray, opens: np.ndarray, limit: int = 1 << 12) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(order of chunks, runs of it): chunks that open with a space follow each other in strings of about limit bytes, as a match never crosses such a space; others stand alone."""
    size = np.diff(ends, prepend=0)
    order = np.concatenate([np.flatnonzero(opens), np.flatnonzero(~opens)])
    joined = int(opens.sum())
    total = np.cumsum(size[order[:joined]])
    bound = np.searchsorted(total, np.arange(limit, (int(total[-1]) if joined else 0) + limit, limit), side="left") + 1
    edges = np.unique(np.concatenate([[0], np.minimum(bound, joined)])).tolist() if joined else [0]
    return order, [*zip(edges[:-1], edges[1:], strict=True), *((i, i + 1) for i in range(joined, len(order)))]


def strings(data: bytes, ends: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(order of chunks, their ends in that order, the strings that they make up)."""
    order, runs = groups(ends, opens)
    size = np.diff(ends, prepend=0)
    start = ends - size
    joined = np.frombuffer(data, np.uint8)[_spread(start[order], size[order])].tobytes()
    stop = np.cumsum(size[order])
    at = [0, *stop.tolist()]
    return order, stop, [joined[at[a] : at[b]].decode("utf-8", "surrogatepass") for a, b in runs]


def split_ids(order: np.ndarray, stop: np.ndarray, ids: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in the chunks' own order, number of ids of each) from the ids of strings() and the bytes that each id spans."""
    total = np.cumsum(width)
    last = np.searchsorted(total, stop)
    if len(stop) and (last[-1] + 1 != len(ids) or (total[last] != stop).any()):
        raise RuntimeError("an id spans two chunks: the pattern isn't the one that the cuts respect")
    count = np.diff(last + 1, prepend=0)
    begin = last + 1 - count
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return ids[_spread(begin[back], count[back])], count[back]
