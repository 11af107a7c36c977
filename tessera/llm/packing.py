"""Packing of documents into sequences: dominance reduction, then best fit.

The plan needs only how many pieces there are of each length, a table of at
most ``capacity`` rows, so it is made on the driver at any corpus size:

* Martello-Toth reduction fixes what some optimal packing contains: a piece
  that fits with no other; a piece and its exact complement; and, where no two
  others fit beside it, a piece and the largest that does.  Each fixed set
  dominates every other set with that piece, so no optimum is lost.
* What remains is packed by best fit in decreasing order of length.

Both work on counts, and the plan is a table of ranges: the pieces of length l
with ranks r..r+n go to the sequences s..s+n at one offset.  Pieces get their
rank from their task's own count plus the sum of the counts of the tasks
before it, per length; no group of equal pieces is ever sorted or gathered.

Defined results: null or empty text is one piece holding only the separator;
a text of any length is cut into as many pieces as it needs;
repeated documents are packed once each; an empty table gives no rows.  Other
columns pass through; those of the result replace any of the same name.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.spark_util import checkpointed
from tessera.llm.suffix_dedup import with_columns
from tessera.llm.token_counts import batches_of, remembered

CAPACITY = 4096
#: Id put after each document.
SEPARATOR = 1

#: A range of pieces: their length, first rank, how many, first sequence, place in the sequence.
Range = tuple[int, int, int, int, int]


class _Plan:
    """Counts of pieces still to place, and the ranges placed so far."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {length: n for length, n in counts.items() if n}
        self.used: dict[int, int] = defaultdict(int)
        self.ranges: list[Range] = []
        self.sequences = 0

    def take(self, length: int, n: int, sequence: int, offset: int) -> None:
        self.ranges.append((length, self.used[length], n, sequence, offset))
        self.used[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n


def reduce_by_dominance(plan: _Plan) -> int:
    """Fixes dominating sets of one or two pieces; returns how many sets."""
    fixed = plan.sequences
    changed = True
    while changed:
        changed = False
        for length in sorted(plan.left, reverse=True):
            n = plan.left.get(length, 0)
            room = plan.capacity - length
            ordered = sorted(plan.left)
            if not n:
                continue
            at = bisect_left(ordered, room + 1) - 1
            partner = ordered[at] if at >= 0 else None
            if partner == length and n == 1:
                partner = ordered[at - 1] if at else None
            if partner is None:
                plan.take(length, n, plan.new(n), 0)
                changed = True
                continue
            if partner != room:
                smallest = []
                for other in ordered:
                    smallest += [other] * min(2, plan.left[other] - (other == length))
                    if len(smallest) >= 2:
                        break
                if len(smallest) >= 2 and sum(smallest[:2]) <= room:
                    continue
            pairs = n // 2 if partner == length else min(n, plan.left[partner])
            first = plan.new(pairs)
            plan.take(length, pairs, first, 0)
            plan.take(partner, pairs, first, length)
            changed = True
    return plan.sequences - fixed


def best_fit(plan: _Plan) -> None:
    """Packs what is left, longest first, each where the least room remains."""
    rooms: list[int] = []
    open_: dict[int, deque[tuple[int, int]]] = defaultdict(deque)

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n:
            if not open_[room]:
                insort(rooms, room)
            open_[room].append((first, n))

    for length in sorted(plan.left, reverse=True):
        while n := plan.left.get(length, 0):
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, free = open_[room].popleft()
                m = min(n, free)
                if free > m:
                    open_[room].appendleft((first + m, free - m))
                if not open_[room]:
                    rooms.pop(at)
                plan.take(length, m, first, plan.capacity - room)
                put(room - length, first, m)
                continue
            each = plan.capacity // length
            whole = n // each
            first = plan.new(whole)
            for k in range(each if whole else 0):
                plan.take(length, whole, first, k * length)
            put(plan.capacity - each * length, first, whole)
            if rest := n - whole * each:
                first = plan.new(1)
                for k in range(rest):
                    plan.take(length, 1, first, k * length)
                put(plan.capacity - rest * length, first, 1)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Range], int]:
    """Ranges that place every piece, and the number of sequences."""
    plan = _Plan(counts, capacity)
    reduce_by_dominance(plan)
    best_fit(plan)
    return plan.ranges, plan.sequences


PIECES = T.StructType([
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])
PLACES = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
_TASK, _RANK = "__task", "__rank"


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, separator: int, with_ids: bool) -> DataFrame:
    """A row per piece, with the task that made it and its rank there among pieces of its length."""
    added = [*PIECES, *([T.StructField("ids", T.BinaryType())] if with_ids else [])]
    named = {f.name for f in added}
    schema = T.StructType([f for f in docs.schema if f.name not in named | {"text"}] + added + [T.StructField(_TASK, T.LongType()), T.StructField(_RANK, T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, task = remembered(tokenizer, True), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        end = np.uint32(separator).astype("<u4").tobytes()
        for batch in (part for whole in batches for part in batches_of(whole)):
            documents = [memory.model.pieces(x) if x else [] for x in batch.column("text").to_pylist()]
            known = memory.learn(documents)
            rows, piece, length, crc, rank, parts = [], [], [], [], [], []
            for i, words in enumerate(documents):
                ids = b"".join([*map(known.__getitem__, words), end])
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    n = len(part) // 4
                    rows.append(i)
                    piece.append(k)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    rank.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        parts.append(part)
            number = np.array(piece, np.int64)
            columns = {
                "piece": pa.array(number, pa.int32()),
                "start": pa.array(number * capacity),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                **({"ids": pa.array(parts, pa.binary())} if with_ids else {}),
                _TASK: pa.array(np.full(len(rows), task), pa.int64()),
                _RANK: pa.array(rank, pa.int64()),
            }
            yield from with_columns(pa.Table.from_batches([batch]).drop_columns(["text"]).take(pa.array(rows, pa.int64())), columns).to_batches()

    return docs.mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """docs without text, a row per piece: piece, start, length, ids_crc32, sequence_id, offset (and ids).

    tokenizer: path of a JSON file of the tokenizers library, on every node.
    """
    docs = docs.drop(*[c for c in docs.columns if c in PLACES.names])
    pieces = checkpointed(cut_documents(docs, tokenizer, capacity, separator, with_ids))
    counts = pieces.groupBy(_TASK, "length").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # at most ``capacity`` rows
    ranges, _ = plan_packing(histogram, capacity)
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    key, rank, sequence, offset = (table[:, 0] << 44) | table[:, 1], table[:, 1], table[:, 3], table[:, 4]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(_RANK).to_numpy() + batch.column("__before").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 44) | mine, side="right") - 1
            columns = {"sequence_id": pa.array(sequence[at] + mine - rank[at]), "offset": pa.array(offset[at])}
            yield from with_columns(pa.Table.from_batches([batch]).drop_columns([_TASK, _RANK, "__before"]), columns).to_batches()

    ranked = pieces.join(offsets, [_TASK, "length"]).select(*pieces.columns, "__before")
    schema = T.StructType([f for f in pieces.schema if f.name not in (_TASK, _RANK)] + list(PLACES))
    return ranked.mapInArrow(place, schema)
