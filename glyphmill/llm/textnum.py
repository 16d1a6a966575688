"""Vectorised text kernels over Arrow string buffers.

Everything here runs inside Arrow-batched Python workers.  Texts are handled
as one byte buffer with row offsets, so the cost per character is a handful of
numpy operations and no Python object is made for a word.

A *word* is a maximal run of ASCII letters or digits and bytes above 0x7F, so
letters of any script count and ASCII punctuation and white space separate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INV = U64(pow(int(_BASE), -1, 1 << 64))

IS_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    IS_WORD[_a:_b] = True

_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, at least n of each."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 18)
        _pow = np.full(size, _BASE, dtype=U64)
        _inv = np.full(size, _INV, dtype=U64)
        _pow[0] = _inv[0] = 1
        np.multiply.accumulate(_pow, out=_pow)
        np.multiply.accumulate(_inv, out=_inv)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):  # combine_chunks keeps several chunks beyond 2 GB
        arr = pa.concat_arrays([c.cast(pa.large_string()) for c in arr.chunks])
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1]
    off = off.astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    buf = buf[off[0] : off[-1]]
    return buf, off - off[0]


def slices(off: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `budget` bytes; a longer row stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + budget, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; no word crosses a row boundary."""
    n = len(buf)
    if n == 0:
        e = np.empty(0, np.int64)
        return e, e, e
    w = IS_WORD[buf]
    start = w.copy()
    start[1:] &= ~w[:-1]
    end = w.copy()
    end[:-1] &= ~w[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] = w[cut]
    end[cut - 1] = w[cut - 1]
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    rows = np.searchsorted(off, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the buffer."""
    pw, iv = _tables(len(buf) + 1)
    acc = np.empty(len(buf) + 1, dtype=U64)
    acc[0] = 0
    np.cumsum((buf.astype(U64) + U64(1)) * pw[: len(buf)], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * iv[starts])


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of every run of k consecutive values; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= U64(0xD6E8FEB86659FD93)
        out += h[i : i + n]
    return mix(out)


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the k-word shingles of each row.

    A row of 1 to k-1 words has one shingle, all of its words; a row without
    words has none.
    """
    starts, ends, rows = word_spans(buf, off)
    if not len(starts):
        return np.empty(0, U64), np.empty(0, np.int64)
    h = span_hashes(buf, starts, ends)
    g = gram_hashes(h, k)
    ok = rows[: len(g)] == rows[k - 1 :] if len(g) else np.empty(0, bool)
    gh, gr = g[ok], rows[: len(g)][ok]
    count = np.bincount(rows, minlength=len(off) - 1)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(rows, short)
        hs = np.array([_fold(h[a : a + c]) for a, c in zip(first, count[short])], dtype=U64)
        gh, gr = np.concatenate([gh, hs]), np.concatenate([gr, short])
        order = np.argsort(gr, kind="stable")
        gh, gr = gh[order], gr[order]
    return gh, gr


def _fold(h: np.ndarray) -> np.uint64:
    return gram_hashes(h, len(h))[0] ^ U64(len(h))
