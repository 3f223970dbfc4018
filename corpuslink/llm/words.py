"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

A text's bytes are UTF-8, and every rule here speaks of single ASCII characters, so that a byte above 0x7F always belongs
to a word and no character is ever cut. Texts are worked on in pieces of half a megabyte (one text is never divided), so a
task's memory follows its longest text, not its partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corpuslink.llm.memory import forgotten

PIECE_BYTES = 1 << 19
U64 = np.uint64


def _white() -> np.ndarray:
    """True for the bytes of a word when words are runs of anything but space, tab, line feed, VT, FF, CR."""
    keep = np.ones(256, bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return keep


def _alnum() -> np.ndarray:
    """True for digits, ASCII lower-case letters and all that is not ASCII."""
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x61:0x7B] = keep[0x80:] = True
    return keep


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    return table


NOT_WHITE, ALNUM, LOWER = _white(), _alnum(), _lower()


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, n, dtype=U64) | U64(1)


LETTER = _odd(7, 256)
BASE, STEP, STEP2 = (int(x) for x in _odd(11, 3))


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix, bit for bit a permutation."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_powers: dict[int, np.ndarray] = forgotten({})


def powers(base: int, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo 2^64; kept in the worker and grown when a longer text comes."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Words:
    """The words of some texts. ``first[d]`` … ``first[d + 1]`` are the words of text ``d``; ``start`` and ``end`` are byte
    positions in ``data``, which holds the texts one after another; ``code`` is a 64-bit hash of each word's bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = keep[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[filled] = inside[filled]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        stops[last] = inside[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.code = self._codes(inside)

    def _codes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        values = np.zeros(len(self.data) + 1, U64)
        with np.errstate(over="ignore"):
            np.multiply(LETTER[self.data], powers(BASE, len(self.data)), out=values[:-1])
            bounds = np.empty(2 * len(self.start), np.int64)
            bounds[0::2], bounds[1::2] = self.start, self.end
            sums = np.add.reduceat(values, bounds)[0::2]
            return mixed(sums * powers(inverse(BASE), len(self.data))[self.start] + (self.end - self.start).astype(U64))

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def windows(self, size: int, step: int = STEP) -> np.ndarray:
        """A hash of the ``size`` words from each word on. Windows that run over the end of a text (or of all) are there as
        well, as far as there are words: ``whole`` tells which ones count."""
        n = len(self.code) - size + 1
        if n <= 0:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            if size <= 10:
                out = np.zeros(n, U64)
                for k in range(size):
                    out *= U64(step)
                    out += self.code[k:k + n]
            else:
                sums = np.zeros(len(self.code) + 1, U64)
                np.cumsum(self.code * powers(step, len(self.code)), out=sums[1:])
                out = (sums[size:] - sums[:-size]) * powers(inverse(step), n)
        return mixed(out + U64(size))

    def whole(self, size: int) -> np.ndarray:
        """Whether the window of ``size`` words from each word on lies within one text, for the windows of ``windows``."""
        n = max(0, len(self.code) - size + 1)
        left = np.repeat(self.first[1:], np.diff(self.first))[:n] - np.arange(n)
        return left >= size

    def joined(self, at: int, size: int) -> bytes:
        """The words from ``at`` on, one space between them."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[at:at + size], self.end[at:at + size], strict=True))


def plain(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """The column as one array of strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``size`` bytes."""
    column = plain(column)
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, stop, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def words_of(column: pa.Array, keep: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, their words)."""
    for row, stop, data, offsets in pieces(column):
        yield row, stop, Words(LOWER[data] if lower else data, offsets, keep)


def signed(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return values.view(np.int64)
