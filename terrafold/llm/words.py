"""Vectorised word hashing over Arrow string columns, shared by the word-level operators.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  These bytes never occur inside a
multi-byte UTF-8 character, so the UTF-8 buffer of a column can be cut without decoding it.
Everything here works on one bounded slice of one batch inside a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the next call."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                table[filled : 2 * filled] = table[:filled] * np.uint64(pow(base, filled, 1 << 64))
                filled *= 2
            tables.append(table)
        _powers = (tables[0], tables[1])
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that near hashes are spread over all bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An order-sensitive hash of two hashes."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


class Words:
    """The words of a slice of documents: byte spans, document index and, per document, the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_SEPARATOR[data]
        begins = np.empty(len(data) + 1, bool)
        begins[:-1] = inside
        begins[1:-1] &= ~inside[:-1]
        begins[-1] = False
        ends = np.empty(len(data) + 1, bool)
        ends[1:] = inside
        ends[0] = False
        ends[1:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        cuts = cuts[inside[cuts] & inside[cuts - 1]]
        begins[cuts] = True
        ends[cuts] = True
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends)
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash per word, A-Z lower-cased first if asked for."""
        return span_hashes(_LOWER[self.data] if lower else self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of each span."""
    if not len(start):
        return np.zeros(0, np.uint64)
    powers, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of rows of about `limit` bytes; null counts as empty.

    A longer text forms a run of its own and is never cut.
    """
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for part in parts:
        part = part.cast(pa.large_string()).fill_null("")
        if len(part):
            _, raw, payload = part.buffers()
            offsets = np.frombuffer(raw, np.int64)[part.offset : part.offset + len(part) + 1]
            data = np.frombuffer(payload, np.uint8) if payload is not None else np.zeros(0, np.uint8)
            first = 0
            while first < len(part):
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
                yield base + first, base + last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                first = last
        base += len(part)
