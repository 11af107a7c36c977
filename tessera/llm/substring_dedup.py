"""Removal of repeated passages of words by relative Lempel-Ziv parsing.

A word goes if a window of 35 words that covers it starts anywhere else too.
``windows`` brings to one bucket the reference blocks (contexts) that share an
anchor: every block of every document is indexed, in the bucket of its anchor.
There each block is factored greedily against all others, all blocks in step.
At its cursor a block looks up its next W words in the index; if another block
has them, the words are compared and the factor is extended, word by word,
while the source agrees.  The next look-up is at the factor's boundary, at the
first window that the factor does not hold whole; without a source the cursor
moves on by one word.  Factors are at least W words long, and the spans that
go are theirs.  Every window is held by a factor or looked up, so none is lost.

Blocks with equal words are one factor of each other; they are told by a
64-bit hash and sent once.  Of windows with the same 64-bit hash but other
words only the first is tried as source.

Defined results: null text has no words; documents shorter than a window keep
all of them; all copies of a passage go, the first as well; repeated rows are
copies of each other; long texts are searched whole.  An empty table gives no rows.  Other columns pass
through; those of the result replace any of the same name.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.suffix_dedup import result_schema, span_array, with_columns
from tessera.llm.windows import Layout, Scheme, gather, repeated_windows

WINDOW = 35
#: Words of an anchor.
GRAM = 8


class Index(NamedTuple):
    """Every window of the reference blocks: sorted hashes, and where each starts."""

    hashes: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int, sums: np.ndarray) -> "Index":
        size = lengths - window + 1
        place = np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)
        hashes = K.range_hashes(symbols, place, place + window, sums)
        order = np.argsort(hashes, kind="stable")
        return cls(hashes[order], place[order])

    def source(self, hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Another place that has the window of each place, or -1."""
        first = np.searchsorted(self.hashes, hashes)
        own = self.place[first] == place
        second = np.minimum(first + 1, len(self.hashes) - 1)
        found = np.where(own, self.place[second], self.place[first])
        return np.where(own & ((second == first) | (self.hashes[second] != hashes)), -1, found)


class Factors(NamedTuple):
    """Where factors start in the symbols, how long they are, and where their sources start."""

    start: np.ndarray
    length: np.ndarray
    source: np.ndarray


def parse(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> Factors:
    """Greedy factors of at least ``window`` symbols of every block against the others."""
    sums = K.prefix_sums(symbols)
    index = Index.of(symbols, starts, lengths, window, sums)
    by_start = np.argsort(starts)
    block_starts, block_ends = starts[by_start], (starts + lengths)[by_start]
    cursor, stop, found = starts.astype(np.int64), (starts + lengths).astype(np.int64), []
    while True:
        open_ = cursor + window <= stop
        cursor, stop = cursor[open_], stop[open_]
        if not len(cursor):
            break
        source = index.source(K.range_hashes(symbols, cursor, cursor + window, sums), cursor)
        at = np.flatnonzero(source >= 0)
        head, source = cursor[at], source[at]
        room = np.minimum(stop[at] - head, block_ends[np.searchsorted(block_starts, source, side="right") - 1] - source)
        length, going = np.zeros(len(at), np.int64), np.arange(len(at))
        while len(going):
            going = going[symbols[head[going] + length[going]] == symbols[source[going] + length[going]]]
            length[going] += 1
            going = going[length[going] < room[going]]
        whole = length >= window
        found.append((head[whole], length[whole], source[whole]))
        cursor = cursor + 1
        cursor[at[whole]] += length[whole] - window
    none = np.zeros(0, np.int64)
    return Factors(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else Factors(none, none, none)


def held_windows(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """Of each window of each block, in their order, whether a factor holds it whole."""
    factors = parse(symbols, starts, lengths, window)
    edge = np.zeros(len(symbols) + 1, np.int32)
    np.add.at(edge, factors.start, 1)
    np.add.at(edge, factors.start + factors.length - window + 1, -1)
    size = lengths - window + 1
    return np.cumsum(edge)[np.arange(size.sum()) + np.repeat(starts - (np.cumsum(size) - size), size)] > 0


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    T.StructField("kept_text", T.StringType()),
])


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> pa.Array:
    """Texts of words joined by one space; of: each document's first word."""
    length = ends - starts
    out_end = np.cumsum(length + 1)
    out = np.full(out_end[-1] if len(out_end) else 0, 0x20, np.uint8)
    target = np.arange(length.sum()) + np.repeat(np.arange(len(length)), length)
    out[target] = gather(data, starts, length)
    total = np.append(0, out_end)
    bounds = total[of]
    # the space after a document's last word goes
    some = np.flatnonzero(np.diff(of) > 0)
    keep = np.ones(len(out), bool)
    keep[bounds[1:][some] - 1] = False
    dropped = np.zeros(len(of), np.int64)
    dropped[1:] = np.cumsum(np.diff(of) > 0)
    return pa.StringArray.from_buffers(len(of) - 1, pa.py_buffer((bounds - dropped).astype(np.int32)), pa.py_buffer(out[keep]))


def _finish(table: pa.Table, lay: Layout, covered: np.ndarray) -> pa.Table:
    removed = np.append(0, np.cumsum(covered))
    kept = ~covered
    columns = {
        "n_words": pa.array(np.diff(lay.bounds), pa.int64()),
        "n_removed": pa.array(np.diff(removed[lay.bounds]), pa.int64()),
        "spans": span_array(covered, lay.bounds),
        "kept_text": joined_words(lay.data, lay.starts[kept], lay.ends[kept], lay.bounds - removed[lay.bounds]),
    }
    return with_columns(table, columns)


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_words, n_removed, spans (removed, in words) and kept_text."""
    scheme = Scheme("words", window, min(GRAM, window))
    return repeated_windows(docs, scheme, held_windows, False, _finish, result_schema(docs, RESULT))
