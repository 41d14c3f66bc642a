"""Words of many texts at once, as byte spans and 64-bit hashes, with numpy only.

A word is a run of bytes outside space and 0x09-0x0D; UTF-8 never uses those bytes
inside a character, so working on bytes is exact. A word's hash is the sum of
code[byte] * P**position, taken from one running sum over the batch, then mixed:
no Python code runs per word. A-Z and a-z share a code when folding case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 3
_POW = {"n": 0}
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True


def _codes(fold: bool) -> np.ndarray:
    x = np.arange(1, 257, dtype=_U)
    if fold:
        x[65:91] = x[97:123]
    return mix(x * _U(0xD1342543DE82EF95)) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODES = {fold: _codes(fold) for fold in (False, True)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POW["n"] < n:
        size = max(n, CHUNK)
        up = np.full(size, _P, _U)
        down = np.full(size, pow(_P, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _POW.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POW["up"], _POW["down"]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of about limit bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word and the index of each text's first word, with the end appended."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), np.zeros(len(off), np.int64)
    ws = _WS[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ws[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ws[1:]
    start = np.flatnonzero(~ws & (before | edge[:n]))
    end = np.flatnonzero(~ws & (after | edge[1:])) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, _U)
    np.cumsum(_CODES[fold][buf] * up[:n], out=total[1:])
    return start, end, mix((total[end] - total[start]) * down[start]), np.searchsorted(start, off)


def joined(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside each text, and the index of each text's first run, with the end appended.

    A text of fewer than k words but at least one gives one hash, of all its words.
    """
    per = np.diff(first)
    runs = np.where(per >= k, per - k + 1, (per > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(runs)])
    doc = np.repeat(np.arange(len(per)), runs)
    at = first[:-1][doc] + (np.arange(begin[-1]) - begin[doc])
    acc = np.full(len(at), k, _U)
    pad = np.concatenate([h, np.zeros(k, _U)])
    for j in range(k):
        inside = at + j < first[1:][doc]
        acc = np.where(inside, mix(acc * _U(0x9FB21C651E98DF25) + pad[at + j]), acc + _U(1))
    return acc, begin
