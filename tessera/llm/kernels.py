"""Vectorised text kernels shared by the corpus operators.

A batch of texts is one byte buffer with document offsets (the layout of an
Arrow string column).  Everything here works on whole buffers with numpy;
nothing loops over characters, words or windows in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: White space that separates words: space and the ASCII range tab..CR.
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Powers are products of one of so many and one of their multiples, so no table grows with the texts.
_SHIFT = 20
_STEP = 1 << _SHIFT


def _powers_of(base: int, n: int) -> np.ndarray:
    """Powers 0..n-1 modulo 2**64."""
    out = np.full(n, U64(base))
    out[:1] = 1
    np.multiply.accumulate(out, out=out)
    return out


class _Powers:
    """Powers of a base modulo 2**64, by small tables."""

    def __init__(self, base: int):
        self.low, self.leap = _powers_of(base, _STEP), pow(base, _STEP, 1 << 64)
        self.high = _powers_of(self.leap, 1)

    def _reach(self, n: int) -> None:
        if len(self.high) * _STEP < n:
            self.high = _powers_of(self.leap, -(-n // _STEP))

    def upto(self, n: int) -> np.ndarray:
        """Powers 0..n-1."""
        if n <= _STEP:
            return self.low[:n]
        self._reach(n)
        return (self.high[: -(-n // _STEP), None] * self.low).ravel()[:n]

    def at(self, exponents: np.ndarray) -> np.ndarray:
        if not len(exponents):
            return np.zeros(0, U64)
        n = int(exponents.max()) + 1
        if n <= _STEP:
            return self.low[exponents]
        self._reach(n)
        return self.high[exponents >> _SHIFT] * self.low[exponents & (_STEP - 1)]


_FORWARD, _BACK = _Powers(_BASE), _Powers(_BASE_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over 64 bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive document ranges of about ``limit`` bytes, one document at least."""
    out, start, n = [], 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        out.append((start, stop))
        start = stop
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


#: All ASCII that is neither letter nor digit.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def segment(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and, per document, its first word's number.

    Words are maximal runs of bytes other than separators, cut at documents.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~separator[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = word[edge]
    edge = offsets[1:][np.diff(offsets) > 0] - 1
    last[edge] = word[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    return range_hashes(_BYTE_CODE[data], starts, ends)


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(symbols) + 1, dtype=U64)
    np.cumsum(symbols * _FORWARD.upto(len(symbols)), out=sums[1:])
    return sums


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hashes of symbol ranges, independent of where the range stands."""
    sums = prefix_sums(symbols) if sums is None else sums
    return mix((sums[ends] - sums[starts]) * _BACK.at(starts) + (ends - starts).astype(U64))


def gram_hashes(symbols: np.ndarray, k: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all runs of k symbols; empty if there are fewer."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    sums = prefix_sums(symbols) if sums is None else sums
    return mix((sums[k:] - sums[:n]) * _BACK.upto(n) + U64(k))


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    out, span = keys.copy(), 1
    while 2 * span <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span : width - span + n])


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal rows start in arrays sorted by these keys."""
    n = len(keys[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = False
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)
