"""Stretches of the bytes of many texts at once: their borders and 64-bit hashes, by numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of texts that are looked at together.
RUN_BYTES = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class StretchHasher:
    """Hashes of stretches of bytes, as differences of one running sum of the bytes' values times powers of ``step``, an
    odd number: its powers have inverses modulo 2 ** 64."""

    def __init__(self, seed: int = 1, step: int = 0x9FB21C651E98DF25):
        self.values = mixed(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93) + U(seed))
        self.step = step
        self._grow(RUN_BYTES + (1 << 16))

    def _grow(self, n: int) -> None:
        def powers(x: int) -> np.ndarray:
            out = np.full(n, U(x))
            out[0] = 1
            return np.multiply.accumulate(out)

        self.up, self.back = powers(self.step), powers(pow(self.step, -1, 1 << 64))

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(raw) > len(self.up):
            self._grow(len(raw) + (len(raw) >> 2))
        values = self.values[raw]
        values *= self.up[: len(raw)]
        sums = np.zeros(len(raw) + 1, dtype=U)
        np.cumsum(values, out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.back[starts]
        return mixed(h + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def row_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a binary column, of ``RUN_BYTES`` at most or of one row: first row, row behind the last, bytes, and
    each row's borders among them."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + RUN_BYTES, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


#: Bytes of words, between ASCII white space, and their lower case.
IN_WORD = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def word_borders(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in texts one after another, with borders at ``edges``."""
    inside = IN_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = edges[1:-1]
    at = inner[inner < len(raw)]
    first[at] = inside[at]
    at = inner[inner > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_parts(raw: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A run and its borders, or one long text in parts that begin with a space."""
    if len(edges) == 2 and len(raw) > RUN_BYTES:
        for part in long_parts(raw, lambda p: ~IN_WORD[p]):
            yield part, np.array([0, len(part)])
    else:
        yield raw, edges


def long_parts(raw: np.ndarray, may_cut: Callable[[np.ndarray], np.ndarray]) -> Iterator[np.ndarray]:
    """One long text in parts of about ``RUN_BYTES``. ``may_cut`` marks, for bytes of it, those that a part may start with;
    the first byte it sees is not asked for."""
    at = 0
    while at < len(raw):
        to = at + RUN_BYTES
        while to < len(raw):
            found = np.flatnonzero(may_cut(raw[to - 1 : to + RUN_BYTES])[1:])
            if len(found):
                to += int(found[0])
                break
            to += RUN_BYTES
        yield raw[at : min(to, len(raw))]
        at = to
