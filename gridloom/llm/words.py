"""Vectorised word and shingle hashing over Arrow string columns.

Texts are handled as one flat UTF-8 byte array per Arrow batch; words are the
runs outside the six ASCII white-space bytes, A-Z in lower case.  Hashes are 64 bits:
two different words, shingles or sets are taken as equal with a chance of
about 2^-64 per compared pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Letters only: ASCII letters and all bytes of other characters.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CHUNK = 1 << 18  # bytes hashed at a time: bounds the temporaries, whatever a text's length


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers with good avalanche (the splitmix64 finaliser)."""
    x = np.asarray(x).astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_MUL = mix64(np.arange(101, 165, dtype=U64)) | U64(1)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, _CHUNK)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=U64)
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its offsets (one more than rows); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_spans(data: np.ndarray, offs: np.ndarray, kind: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word (run of bytes of the kind), in order; no word crosses an offset."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = kind[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True, salt: int = 0) -> np.ndarray:
    """64-bit hash of each span (sorted, not overlapping), A-Z as a-z if lower; another salt makes another hash."""
    out = np.empty(len(start), dtype=U64)
    table, i = _BYTE_LOWER if lower else _BYTE, 0
    if salt:
        table = mix64(table + U64(salt) * _MUL[60])
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _CHUNK, "right")))
        a, b = int(start[i]), int(end[j - 1])
        up, down = _power(b - a + 1)
        sums = np.zeros(b - a + 1, dtype=U64)
        np.cumsum(table[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * _MUL[63])
        i = j
    return out


def shingles(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles with the row of each, in order of (row, position).

    A row with words, but fewer than k, has its whole sequence as one shingle; a row without words has none.
    """
    start, end = word_spans(data, offs)
    words = span_hashes(data, start, end)
    first = np.searchsorted(start, offs[:-1])
    last = np.searchsorted(start, offs[1:])
    n = last - first
    rows, sums = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0)), None
    at = first[rows] + (np.arange(len(rows)) - np.repeat(np.cumsum(np.maximum(n - k + 1, 0)) - np.maximum(n - k + 1, 0), np.maximum(n - k + 1, 0)))
    sums = np.zeros(len(rows), dtype=U64)
    for j in range(k):
        sums += words[at + j] * _MUL[j]
    for m in range(1, k):
        some = np.flatnonzero(n == m)
        if len(some):
            h = np.full(len(some), _MUL[20 + m], dtype=U64)
            for j in range(m):
                h += words[first[some] + j] * _MUL[j]
            rows, sums = np.concatenate([rows, some]), np.concatenate([sums, h])
    return mix64(sums), rows


def distinct_shingles(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row in ascending order, and offsets by row."""
    h, rows = shingles(data, offs, k)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    h, rows = h[keep], rows[keep]
    return h, np.searchsorted(rows, np.arange(len(offs)))
