"""Vectorised scanning of UTF-8 text in Arrow batches: word runs, word hashes, n-gram hashes.

All scans work on bytes. Every class that the operators need is closed under UTF-8 (white space and ASCII
classes are single bytes; bytes from 0x80 on belong to words), so no text is decoded. Hashes are 64 bits wide;
a text may have any length: a chunk is at most ``CHUNK`` bytes unless one document alone is longer, and word
hashes are computed in segments, so scratch memory beyond the document's own words is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_rng = np.random.Generator(np.random.PCG64(20240601))
EXACT = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)
FOLDED = EXACT.copy()
FOLDED[0x41:0x5B] = FOLDED[0x61:0x7B]
_R = U64(0x9E3779B97F4A7C15 | 3)
_R_INV = U64(pow(int(_R), -1, 1 << 64))
NGRAM_MUL = _rng.integers(1, 1 << 63, 64, dtype=U64) * U64(2) + U64(1)
_pow = np.ones(1, U64)
_inv = np.ones(1, U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK + 1)
        step, back = np.full(size, _R, U64), np.full(size, _R_INV, U64)
        step[0] = back[0] = 1
        _pow, _inv = np.cumprod(step, dtype=U64), np.cumprod(back, dtype=U64)
    return _pow, _inv


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (n + 1); null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets within them) of consecutive whole rows."""
    data, offsets = column_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of member bytes, none across rows; and each row's first run (n + 1)."""
    inside = member[buf]
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    cut = edge[inside[edge] & inside[edge - 1]]
    first[cut] = True
    last[cut - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_runs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = EXACT) -> np.ndarray:
    """A 64-bit hash of each run, computed in segments of about CHUNK bytes."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + CHUNK, "left")))
        top = int(ends[j - 1])
        power, inverse = _powers(top - base + 1)
        sums = np.zeros(top - base + 1, U64)
        np.cumsum(table[buf[base:top]] * power[: top - base], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(U64) * NGRAM_MUL[63])


def text_hash(text: str, table: np.ndarray = EXACT) -> int:
    """hash_runs() of one string."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(hash_runs(data, np.array([0]), np.array([len(data)]), table)[0])


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n consecutive words (len - n + 1 of them)."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, U64)
    total = words[:size] * NGRAM_MUL[0]
    for k in range(1, n):
        total += words[k : k + size] * NGRAM_MUL[k]
    return mix(total + U64(n))


def counts_between(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the sorted positions lie in each row."""
    return np.diff(np.searchsorted(positions, offsets))
