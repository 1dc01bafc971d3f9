"""Hashes of runs of words by prefix sums, vectorised over a whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An odd multiplier and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class Powers:
    """Powers of BASE and INVERSE, extended as longer texts come."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, np.empty(0, np.uint64), np.empty(0, np.uint64)

    def upto(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 14)
            self.up, self.down = _powers(BASE, self.n), _powers(INVERSE, self.n)

    def runs(self, values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of values[first:end] for each pair, which does not depend on where it lies."""
        self.upto(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return _mix((sums[end] - sums[first]) * self.down[first] + (end - first).astype(np.uint64))


def words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text with A-Z lower-cased, and where its words begin and end in them."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True]))))
    return raw, edges[::2], edges[1::2]


#: Texts of an Arrow column are taken together up to so many bytes.
TOGETHER = 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def batch_words(column) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some texts of an Arrow column of strings at a time: their bytes with A-Z lower-cased, where words begin
    and end in them, and how many words end with each text. Null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        k = max(i + 1, int(np.searchsorted(at, at[i] + TOGETHER, side="right")) - 1)
        raw, own = _LOWER[data[at[i] : at[k]]], at[i : k + 1] - at[i]
        if len(raw):
            space = (raw == 32) | ((raw >= 9) & (raw <= 13))
            new = np.zeros(len(raw) + 1, bool)
            new[own] = True  # no word goes from one text into the next
            first = np.flatnonzero(~space & (new[:-1] | np.concatenate(([True], space[:-1]))))
            end = np.flatnonzero(~space & (new[1:] | np.concatenate((space[1:], [True])))) + 1
        else:
            first = end = np.empty(0, np.int64)
        yield raw, first, end, np.searchsorted(first, own[1:])
        i = k


def word_hashes(raw: np.ndarray, first: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    return powers.runs(raw.astype(np.uint64) + np.uint64(1), first, end)
