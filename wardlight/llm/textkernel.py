"""Vectorised words and word hashes of Arrow text columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes of texts taken together, and bytes hashed together: they bound a task's memory, not what is read.
CHUNK_BYTES, HASH_BYTES = 512 << 10, 512 << 10

_rng = np.random.default_rng(20_260_101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64 constants)."""
    h = h + U64((salt * 0x9E3779B97F4A7C15) % 2**64)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(n, HASH_BYTES + 1)
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Words:
    """Words of consecutive documents: hash, byte span; document d has words bounds[d]:bounds[d+1].

    Bytes are hashed in blocks of whole words, so a very long text needs 8-byte columns for a block only.
    ``prefixes`` adds the hash of each word's first k bytes for every k.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool, prefixes: tuple[int, ...] = ()):
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        self.data, self.offsets, n = data, offsets, len(data)
        filled = ~SPACE[data]
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        starts = filled.copy()
        starts[1:] &= ~filled[:-1] | begins[1:n]
        ends = filled.copy()
        ends[:-1] &= ~filled[1:] | begins[1:n]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.hash, *self.prefix = span_hashes(FOLD[data] if fold else data, self.starts, self.ends, *(np.minimum(self.starts + k, self.ends) for k in prefixes))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def span_hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the byte spans from starts to each of the ends; spans are in order, the first ends are the farthest."""
    out = [np.zeros(len(starts), U64) for _ in ends]
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends[0], starts[first] + HASH_BYTES, side="right")))
        at, n = int(starts[first]), int(ends[0][last - 1] - starts[first])
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[data[at : at + n]] * power[:n], out=total[1:])
        begin = starts[first:last] - at
        for hashes, end in zip(out, ends):
            hashes[first:last] = mix((total[end[first:last] - at] - total[begin]) * inverse[begin])
        first = last
    return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets; null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (first, end) of about ``limit`` bytes with their bytes and offsets; a longer text is a range of its own."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data, offsets[first : end + 1]
        first = end


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words within one document, with the position of its first word."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n - width + 1, U64)
    for j in range(width):
        total = total * U64(_BASE) + hashes[j : n - width + 1 + j]
    valid = np.ones(n - width + 1, bool)
    for back in range(1, width):
        at = bounds[1:-1] - back
        valid[at[(at >= 0) & (at < len(valid))]] = False
    at = np.flatnonzero(valid)
    return mix(total[at], width), at
