"""Vectorised helpers over Arrow text columns: tokens, their hash codes, and hashes of windows.

All hashes are polynomial prefix sums modulo 2^64 with an odd base, finished by a mixing step, so that the hash of any span
comes from two prefix values and one inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
#: Bytes of text handled at a time; a longer document is handled alone, its words in blocks of that many bytes.
SLICE = 1 << 20
#: Powers of a base that stay in memory, at most; more are worked out for one use.
_POWERS = 1 << 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if base in _powers and len(_powers[base][0]) >= n:
        return _powers[base][0][:n], _powers[base][1][:n]
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(max(n, 1 << 16), b, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    if n <= _POWERS:
        _powers[base] = both[0], both[1]
    return both[0][:n], both[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Hashes of spans of a sequence of codes."""

    def __init__(self, codes: np.ndarray, base: int):
        p, self.inverse = powers(base, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * p[:-1], out=self.sums[1:])

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all windows of ``width`` codes, by their starts."""
        n = len(self.sums) - 1 - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + np.uint64(width * 0x2545F4914F6CDD1D % 2**64))


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a text column in runs of up to ``most`` bytes: (first row, end row, bytes, offsets of rows in them)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Tokens:
    """Tokens of several texts: byte spans, the range of each text's tokens, and 64-bit codes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        """inside: a table of 256 flags, true for bytes of tokens."""
        word = inside[data]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text's edge parts tokens as well
        opens[first] |= word[first]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        closes[last] |= word[last]
        self.data, self.offsets = data, offsets
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.ranges = np.searchsorted(self.starts, offsets)

    def codes(self, base: int = BASES[0]) -> np.ndarray:
        if len(self.data) <= 2 * SLICE:
            return Prefix(self.data, base).spans(self.starts, self.ends)
        out, i = [np.zeros(0, np.uint64)], 0
        while i < len(self.starts):
            at = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, at + SLICE, "right")))
            out.append(Prefix(self.data[at : self.ends[j - 1]], base).spans(self.starts[i:j] - at, self.ends[i:j] - at))
            i = j
        return np.concatenate(out)


def char_class(chars: bytes) -> np.ndarray:
    """A table of 256 flags, true for these bytes."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Words that white space (space, \t \n \v \f \r) parts.
NOT_BLANK = ~char_class(b" \t\n\x0b\x0c\r")
#: ASCII letters and digits and all bytes beyond ASCII; A-Z as a-z.
ALPHANUMERIC = char_class(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
