"""Exact words of Arrow text columns, coded by a dictionary of each chunk: no hash stands for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from wardlight.llm.textkernel import FOLD, text_chunks


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to a word: the inclusive ranges and all bytes of characters beyond ASCII."""
    keep = np.zeros(256, bool)
    keep[0x80:] = True
    for first, last in ranges:
        keep[first : last + 1] = True
    return keep


LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
LETTERS_DIGITS = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))


class Coded:
    """Words of consecutive documents: ``codes`` into ``words`` (distinct), document d has codes[bounds[d]:bounds[d+1]]. A-Z are lower-cased."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        filled, n = keep[data], len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        starts = filled.copy()
        starts[1:] &= ~filled[:-1] | begins[1:n]
        self.bounds = np.searchsorted(np.flatnonzero(starts), offsets)
        self.counts = np.diff(self.bounds)
        letters = FOLD[data[filled]]
        first = np.flatnonzero(starts[filled])  # where each word begins among the letters
        ends = np.append(first, len(letters)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(letters)])
        coded = column.dictionary_encode()
        self.codes, self.words = coded.indices.to_numpy(), coded.dictionary

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def coded_chunks(column: pa.Array, keep: np.ndarray, limit: int) -> Iterator[tuple[int, int, Coded]]:
    """Row ranges (first, end) of about ``limit`` bytes with their words; a longer text is a range of its own, null reads as empty."""
    for first, end, data, offsets in text_chunks(column, limit):
        yield first, end, Coded(data, offsets, keep)
