"""Removal of long repeated byte strings by blockwise suffix sorting.

A byte goes if a string of 50 bytes that covers it also starts in a document
with a smaller id.  ``windows`` brings the places that can repeat to one
bucket; here the suffixes of a bucket are sorted one block at a time, blocks
being ranges of leading bytes, so that memory holds the suffixes of a block
and the ranks of a difference-cover sample, never all suffixes.

Within a block suffixes are ordered by their first and last V bytes.  Those
that still tie are resolved without further comparing: for any two places i
and j there is a shift d < V for which i + d and j + d both lie in the cover
sample, and the sample's ranks were computed once for the whole bucket.

Defined results: null text is empty; the ids of documents decide, so rows that
repeat an id keep what only they share, and a null id counts as the largest.
Texts shorter than the window keep all bytes; long ones are searched whole.  An empty table gives no rows.
Other columns pass through; those of the result replace any of the same name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.windows import Layout, Scheme, repeated_windows

WINDOW = 50
#: Bytes of an anchor; longer ones repeat less by chance but lie closer together.
GRAM = 20

#: A difference cover: every difference modulo V is one of two members.
V = 13
COVER = (0, 1, 3, 9)
#: Suffixes sorted at once.
BLOCK = 1 << 19


def _packed(symbols: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on as one big-endian number."""
    wide = np.zeros(len(symbols) + 8, np.uint64)
    wide[: len(symbols)] = symbols
    for shift in (1, 2, 4):
        wide[:-shift] = (wide[:-shift] << np.uint64(8 * shift)) | wide[shift:]
    return wide


def _sample_ranks(packed: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the string of ``depth`` bytes at each place of the cover sample; elsewhere 0."""
    size = np.maximum(lengths - depth + 1, 0)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = np.repeat(starts, size) + inner
    place = place[np.isin(place % V, COVER)]
    shifts = [*range(0, depth - 7, 8)]
    if shifts[-1] + 8 < depth:
        shifts.append(depth - 8)
    keys = [packed[place + s] for s in shifts]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    new[K.group_starts(*(k[order] for k in keys))] = 1
    ranks = np.zeros(len(packed), np.int64)
    ranks[place[order]] = np.cumsum(new)
    return ranks


def equal_windows(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """A class for each window of each context: equal numbers, equal bytes."""
    size = lengths - window + 1
    place = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    label = np.arange(len(place))
    if len(place) < 2:
        return label
    packed = _packed(symbols)
    ranks = _sample_ranks(packed, starts, lengths, window - V)
    shift_of = (np.asarray(COVER)[None, :] - np.arange(V)[:, None]) % V
    leading = (packed[place] >> np.uint64(40)).astype(np.int64)
    by_leading = np.argsort(leading, kind="stable")
    edges = [0]
    for edge in K.group_starts(leading[by_leading])[1:].tolist():
        if edge - edges[-1] >= BLOCK:
            edges.append(edge)
    for low, high in zip(edges, [*edges[1:], len(place)], strict=True):
        block = by_leading[low:high]
        at = place[block]
        keys = [packed[at], packed[at + V - 8], packed[at + window - V], packed[at + window - 8]]
        order = np.lexsort(keys[::-1])
        first = K.group_starts(*(k[order] for k in keys))
        count = np.diff(np.append(first, len(order)))
        tied = np.repeat(count > 1, count)
        run = np.repeat(np.arange(len(first)), count)[tied].astype(np.uint64)
        who = block[order[tied]]
        if not len(who):
            continue
        shift = shift_of[place[who] % V]
        rank = ranks[place[who][:, None] + shift]
        bits = np.uint64(max(1, int(ranks.max()).bit_length()))
        key = ((run[:, None] << np.uint64(4) | shift.astype(np.uint64)) << bits | rank.astype(np.uint64)).ravel()
        member = np.repeat(who, len(COVER))
        order = np.argsort(key, kind="stable")
        first = K.group_starts(key[order])
        least = np.minimum.reduceat(member[order], first)
        np.minimum.at(label, member[order], np.repeat(least, np.diff(np.append(first, len(order)))))
    return np.unique(label, return_inverse=True)[1]


RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    T.StructField("kept", T.BinaryType()),
])


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs within documents: starts and stops in their document; first run of each document."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[bounds] = True
    start = np.flatnonzero(mask & (edge[:-1] | ~np.append(False, mask[:-1]))) if len(mask) else np.zeros(0, np.int64)
    stop = np.flatnonzero(mask & (edge[1:] | ~np.append(mask[1:], False))) + 1 if len(mask) else np.zeros(0, np.int64)
    of = np.searchsorted(start, bounds)
    base = np.repeat(bounds[:-1], np.diff(of))
    return start - base, stop - base, of


def span_array(mask: np.ndarray, bounds: np.ndarray) -> pa.Array:
    start, stop, of = runs(mask, bounds)
    both = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), both)


def _finish(table: pa.Table, lay: Layout, covered: np.ndarray) -> pa.Table:
    bounds = lay.bounds
    removed = np.append(0, np.cumsum(covered))
    kept_at = (bounds - removed[bounds]).astype(np.int32)
    kept = pa.BinaryArray.from_buffers(pa.binary(), table.num_rows, [None, pa.py_buffer(kept_at), pa.py_buffer(lay.data[~covered])])
    columns = {
        "n_bytes": pa.array(np.diff(bounds), pa.int64()),
        "n_removed": pa.array(np.diff(removed[bounds]), pa.int64()),
        "spans": span_array(covered, bounds),
        "kept": kept,
    }
    return with_columns(table, columns)


def with_columns(table: pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
    table = table.drop_columns([c for c in columns if c in table.column_names])
    for name, column in columns.items():
        table = table.append_column(name, column)
    return table


def result_schema(docs: DataFrame, result: T.StructType) -> T.StructType:
    return T.StructType([f for f in docs.schema if f.name not in result.names] + list(result))


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with n_bytes, n_removed, spans (removed, in bytes) and kept (what remains)."""
    scheme = Scheme("bytes", window, min(GRAM, window))
    return repeated_windows(docs, scheme, equal_windows, True, _finish, result_schema(docs, RESULT))
