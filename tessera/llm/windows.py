"""Exact search for repeated windows of symbols over a whole corpus.

A window is W consecutive symbols (bytes or words) of one document.  Sorting
every window of the corpus would move eight bytes or more for each symbol, so
windows are first represented by *anchors*: the k-gram with the smallest hash
within a window.  Equal windows choose equal anchors, and neighbouring windows
mostly share one, so about 2 / (W - k + 2) of the positions are anchors.

The search asks and answers, and every exchange carries packed arrays:

1. each chunk of documents asks: (anchor, context hash, document) of its
   anchors, dealt by anchor;
2. each bucket of anchors names one place for every distinct context whose
   anchor also occurs elsewhere in another context;
3. the chunks that hold those places send the symbols of the context;
4. a *matcher* tells which windows of the bucket's contexts are equal, and the
   bucket answers each asking chunk with a bit per window;
5. each chunk marks the windows and builds its result.

Copies of a context meet as equal (anchor, context hash) pairs, so a passage
that is repeated any number of times is sent, and matched, once.  A bucket
holds packed numbers, never texts of all its documents.  Chunks and buckets
follow ``spark.sql.shuffle.partitions``; a document is the smallest unit that
is never split.  The text is shuffled once: the plan reuses that exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.spark_util import columns_of, compressed, fresh, restored

CHUNK = "__chunk"
#: Chunks of documents per shuffle partition.
CHUNKS_PER_PARTITION = 4
#: Rows that are packed at once.
ROWS = 10_000
#: Symbols that a kernel holds at once, unless one document has more.
SLICE = 1 << 20
NO_ID = np.iinfo(np.int64).max


class Scheme(NamedTuple):
    """What a window is: its unit ('bytes' or 'words'), length and anchor length."""

    unit: str
    window: int
    gram: int


class Layout(NamedTuple):
    """Symbols of a chunk: codes, document bounds and where words stand in the bytes."""

    data: np.ndarray
    offsets: np.ndarray
    symbols: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray | None
    ends: np.ndarray | None


class Anchors(NamedTuple):
    key: np.ndarray
    context: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray


class Places(NamedTuple):
    """All anchors of a bucket, sorted by key and context.

    key, context, doc: as asked; row, index: the request and the place in it;
    of: number of the distinct (key, context) pair of each.  By pair: where it
    starts, how often it occurs and its smallest document id; fine: whether
    another context has the same key, in another document.
    """

    doc: np.ndarray
    row: np.ndarray
    index: np.ndarray
    of: np.ndarray
    first: np.ndarray
    count: np.ndarray
    least: np.ndarray
    fine: np.ndarray


def layout(table: pa.Table, scheme: Scheme) -> Layout:
    data, offsets = K.text_buffer(table["text"])
    if scheme.unit == "bytes":
        return Layout(data, offsets, data, offsets, None, None)
    starts, ends, bounds = K.segment(data, offsets)
    return Layout(data, offsets, K.word_hashes(data, starts, ends), bounds, starts, ends)


def ordered(table: pa.Table) -> pa.Table:
    """The same rows in the same order however they were fetched."""
    table = table.combine_chunks()
    return table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))


def anchors(lay: Layout, scheme: Scheme) -> Anchors:
    window, gram = scheme.window, scheme.gram
    found = []
    for a, b in K.slices(lay.bounds, SLICE):
        low, high = lay.bounds[a], lay.bounds[b]
        codes = lay.symbols[low:high]
        if high - low < window:
            continue
        if scheme.unit == "bytes":
            codes = K._BYTE_CODE[codes]
        bounds = lay.bounds[a : b + 1] - low
        sums = K.prefix_sums(codes)
        grams = K.gram_hashes(codes, gram, sums)
        bits = np.uint64(max(24, len(codes).bit_length()))
        keys = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        lowest = (K.sliding_min(keys, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        doc = np.repeat(np.arange(b - a), np.diff(bounds))[: len(lowest)]
        whole = np.flatnonzero(np.arange(window, window + len(lowest)) <= bounds[doc + 1])
        if not len(whole):
            continue
        at = lowest[whole]
        run = K.group_starts(at, doc[whole])
        first, last = whole[run], whole[np.append(run[1:], len(whole)) - 1]
        shift = (at[run] - first).astype(np.uint64)
        context = K.mix(K.range_hashes(codes, first, last + window, sums) + shift * np.uint64(0xD1342543DE82EF95))
        found.append((K.mix(grams[at[run]] ^ np.uint64(0xA5A5A5A5)), context, doc[first] + a, first + low, last + low))
    if not found:
        none = np.zeros(0, np.int64)
        return Anchors(none.astype(np.uint64), none.astype(np.uint64), none, none, none)
    return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _by_bucket(found: Anchors, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors ordered by bucket; the buckets present and where each starts."""
    bucket = (found.key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = K.group_starts(bucket[order])
    return order, bucket[order][starts], np.append(starts, len(order))


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()


def _rising(ids: np.ndarray) -> bytes:
    """Ids in order: the first, and the steps to the next ones in as many bytes as the largest needs."""
    steps = np.diff(ids).view(np.uint64)
    width = 1 << max(0, (int(steps.max(initial=0)).bit_length() + 7) // 8 - 1).bit_length()
    return bytes([width]) + ids[:1].tobytes() + steps.astype(f"<u{width}").tobytes()


def _risen(packed: bytes) -> np.ndarray:
    """What ``_rising`` has packed."""
    first, steps = np.frombuffer(packed, np.int64, 1, 1), np.frombuffer(packed, f"<u{packed[0]}", -1, 9)
    return np.append(first, first + np.cumsum(steps.astype(np.uint64)).view(np.int64))


#: Bits of a context's hash that are sent; with 32 bits of its anchor and the bucket they tell contexts apart.
CONTEXT = np.uint64(48)


def _ask(table: pa.Table, scheme: Scheme, buckets: int, own: str) -> pa.Table:
    chunk, table = _chunk(table, own)
    found = anchors(layout(table, scheme), scheme)
    order, present, edge = _by_bucket(found, buckets)
    key, context, doc = (found.key[order] >> np.uint64(32)).astype(np.uint32), found.context[order] & ((np.uint64(1) << CONTEXT) - np.uint64(1)), _ids(table)[found.doc[order]]
    cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    n = len(present)
    high, low = (context >> np.uint64(32)).astype(np.uint16), context.astype(np.uint32)
    # documents of a chunk are in the order of their ids
    docs = pa.array([_rising(doc[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    return pa.table({"bucket": pa.array(present, pa.int64()), "chunk": pa.array([chunk] * n, pa.int64()), "key": cut(key), "high": cut(high), "low": cut(low), "doc": docs})


ASKED = "bucket long, chunk long, key binary, high binary, low binary, doc binary"


def _column(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """Arrays packed in a binary column, one after another, and their lengths."""
    parts = [np.frombuffer(x, kind) for x in table[name].to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(x) for x in parts], np.int64)


def _places(asked: pa.Table, across: bool) -> Places:
    key, sizes = _column(asked, "key", np.uint32)
    high, low = _column(asked, "high", np.uint16)[0], _column(asked, "low", np.uint32)[0]
    context = high.astype(np.uint64) << np.uint64(32) | low
    docs = [_risen(x) for x in asked["doc"].to_pylist()]
    doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    index = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.lexsort((context, key))
    key, context, doc = key[order], context[order], doc[order]
    first = K.group_starts(key, context)
    count = np.diff(np.append(first, len(key)))
    of = np.repeat(np.arange(len(first)), count)
    least = np.minimum.reduceat(doc, first) if len(first) else doc
    most = np.maximum.reduceat(doc, first) if len(first) else doc
    start = K.group_starts(key[first])
    pairs = np.diff(np.append(start, len(first)))
    fine = pairs > 1
    if across and len(start):
        fine &= np.minimum.reduceat(least, start) < np.maximum.reduceat(most, start)
    return Places(doc, row[order], index[order], of, first, count, least, np.repeat(fine, pairs))


def _want(asked: pa.Table, across: bool) -> pa.Table:
    asked = asked.combine_chunks().sort_by("chunk")
    at = _places(asked, across)
    chosen = at.first[at.fine]
    row, index = at.row[chosen], at.index[chosen]
    order = np.lexsort((index, row))
    row, index = row[order], index[order].astype(np.int32)
    starts = K.group_starts(row)
    edge = np.append(starts, len(row))
    chunks = asked["chunk"].to_numpy()[row[starts]]
    return pa.table({
        CHUNK: pa.array(chunks, pa.int64()),
        "bucket": pa.array([asked["bucket"][0].as_py()] * len(starts), pa.int64()),
        "index": pa.array([index[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
    })


WANTED = f"{CHUNK} long, bucket long, index binary"


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges, one after another."""
    ends = np.cumsum(lengths)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def _send(table: pa.Table, wanted: pa.Table, scheme: Scheme, buckets: int, own: str) -> pa.Table:
    out = {"bucket": [], "chunk": [], "index": [], "length": [], "content": []}
    if wanted.num_rows and table.num_rows:
        chunk, table = _chunk(table, own)
        lay = layout(table, scheme)
        found = anchors(lay, scheme)
        order, present, edge = _by_bucket(found, buckets)
        for bucket, packed in zip(wanted["bucket"].to_pylist(), wanted["index"].to_pylist(), strict=True):
            chosen = order[edge[np.searchsorted(present, bucket)] + np.frombuffer(packed, np.int32)]
            start, length = found.first[chosen], found.last[chosen] - found.first[chosen] + scheme.window
            out["bucket"].append(bucket)
            out["chunk"].append(chunk)
            out["index"].append(packed)
            out["length"].append(length.astype(np.int32).tobytes())
            out["content"].append(compressed(gather(lay.symbols, start, length).tobytes()))
    kinds = {"bucket": pa.int64(), "chunk": pa.int64()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})


SENT = "bucket long, chunk long, index binary, length binary, content binary"

#: (symbols of all contexts, starts and lengths of contexts, window) to a value for each window of each context:
#: across documents a class, equal for equal windows; else whether another context has it.
Matcher = Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def _answer(asked: pa.Table, sent: pa.Table, scheme: Scheme, across: bool, matcher: Matcher) -> pa.Table:
    asked = asked.combine_chunks().sort_by("chunk")
    at = _places(asked, across)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    if across:
        hit = at.doc > at.least[at.of]
    else:
        hit = (at.count > 1)[at.of]
    mask = np.where(hit, every, np.uint64(0))
    if sent.num_rows:
        number = {c: i for i, c in enumerate(asked["chunk"].to_pylist())}
        index, sizes = _column(sent, "index", np.int32)
        length, _ = _column(sent, "length", np.int32)
        contents = [np.frombuffer(restored(x), np.uint8 if scheme.unit == "bytes" else np.uint64) for x in sent["content"].to_pylist()]
        symbols = np.concatenate(contents)
        row = np.repeat([number[c] for c in sent["chunk"].to_pylist()], sizes)
        # contexts come by sender; bring them into the order of the pairs that they stand for
        chosen = at.first[at.fine]
        start = np.cumsum(length, dtype=np.int64) - length
        back = np.lexsort((index, row))
        mine = np.empty(len(chosen), np.int64)
        mine[np.lexsort((at.index[chosen], at.row[chosen]))] = back
        start, length = start[mine], length[mine].astype(np.int64)
        windows = length - scheme.window + 1
        told = matcher(symbols, start, length, scheme.window)
        pair = np.repeat(np.flatnonzero(at.fine), windows)
        bit = np.uint64(1) << (np.arange(len(pair)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.uint64)
        if across:
            least = np.full(int(told.max()) + 1 if len(told) else 0, NO_ID)
            np.minimum.at(least, told, at.least[pair])
            # of the places of a pair, those of its smallest document may differ from the rest
            known, own = least[told], at.least[pair]
            full = np.zeros(len(at.first), np.uint64)
            np.bitwise_or.at(full, pair, np.where(known < own, bit, np.uint64(0)))
            mask = np.where(at.fine[at.of], np.where(hit, every, full[at.of]), mask)
        else:
            full = np.zeros(len(at.first), np.uint64)
            np.bitwise_or.at(full, pair, np.where(told | (at.count[pair] > 1), bit, np.uint64(0)))
            mask = np.where(at.fine[at.of], full[at.of], mask)
    some = np.flatnonzero(mask)
    order = some[np.lexsort((at.index[some], at.row[some]))]
    row = at.row[order]
    starts = K.group_starts(row)
    edge = np.append(starts, len(row))
    cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
    return pa.table({
        CHUNK: pa.array(asked["chunk"].to_numpy()[row[starts]], pa.int64()),
        "bucket": pa.array([asked["bucket"][0].as_py()] * len(starts), pa.int64()),
        "index": cut(at.index[order].astype(np.int32)),
        "mask": cut(mask[order]),
    })


ANSWERED = f"{CHUNK} long, bucket long, index binary, mask binary"


def _covered(lay: Layout, answers: pa.Table, scheme: Scheme, buckets: int) -> np.ndarray:
    """Symbols that lie within a marked window."""
    edge_of = np.zeros(len(lay.symbols) + 1, np.int32)
    if answers.num_rows:
        found = anchors(lay, scheme)
        order, present, edge = _by_bucket(found, buckets)
        places, masks = [], []
        for bucket, packed, mask in zip(*(answers[c].to_pylist() for c in ("bucket", "index", "mask")), strict=True):
            places.append(order[edge[np.searchsorted(present, bucket)] + np.frombuffer(packed, np.int32)])
            masks.append(np.frombuffer(mask, np.uint64))
        place, mask = np.concatenate(places), np.concatenate(masks)
        size = found.last[place] - found.first[place] + 1
        shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        marked = (np.repeat(mask, size) >> shift.astype(np.uint64)) & np.uint64(1) > 0
        window = (np.repeat(found.first[place], size) + shift)[marked]
        np.add.at(edge_of, window, 1)
        np.add.at(edge_of, window + scheme.window, -1)
    return np.cumsum(edge_of[:-1]) > 0


PACKED = f"{CHUNK} long, packed binary"


def dealt(docs: DataFrame) -> tuple[DataFrame, str, int]:
    """Rows of docs by chunk, many in one, compressed; the name of the chunk's column, and the number of buckets.

    Rows of one id, or of none, are spread by their texts.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(CHUNKS_PER_PARTITION * buckets)).cast("long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            number = batch.column(0).to_numpy()
            order = np.argsort(number, kind="stable")
            rows = pa.Table.from_batches([batch]).take(pa.array(order)).drop_columns([batch.schema.names[0]])
            starts = K.group_starts(number[order])
            parts = [_stream(rows.slice(a, b - a)) for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True)]
            yield pa.record_batch({CHUNK: pa.array(number[order][starts], pa.int64()), "packed": pa.array(parts, pa.binary())})

    # the chunk stands first, so that its name meets no other
    return docs.select(chunk.alias(fresh(docs, CHUNK)), *columns_of(docs)).mapInArrow(pack, PACKED), CHUNK, buckets


def _stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows.combine_chunks())
    return compressed(sink.getvalue())


def _chunk(packed: pa.Table, own: str) -> tuple[int, pa.Table]:
    """The number of a chunk and its rows, in their order."""
    parts = [pa.ipc.open_stream(restored(x)).read_all() for x in packed["packed"].to_pylist()]
    return packed[own][0].as_py(), ordered(pa.concat_tables(parts))


def repeated_windows(docs: DataFrame, scheme: Scheme, matcher: Matcher, across: bool, finish: Callable[[pa.Table, Layout, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
    """Marks symbols covered by repeated windows and returns ``finish`` of every chunk.

    docs: doc_id, text and any others.  across: a window counts as repeated if
    it also starts in a document with a smaller id; else if it starts anywhere
    else.  finish: (rows, layout, mask of covered symbols) to rows of schema.
    """
    if scheme.window - scheme.gram + 1 > 64:
        raise ValueError("windows of one anchor must fit in 64 bits")
    chunks, own, buckets = dealt(docs)

    def ask(table: pa.Table) -> pa.Table:
        return _ask(table, scheme, buckets, own)

    def want(table: pa.Table) -> pa.Table:
        return _want(table, across)

    def send(table: pa.Table, wanted: pa.Table) -> pa.Table:
        return _send(table, wanted, scheme, buckets, own)

    def answer(asked: pa.Table, sent: pa.Table) -> pa.Table:
        return _answer(asked, sent, scheme, across, matcher)

    def mark(table: pa.Table, answers: pa.Table) -> pa.Table:
        _, table = _chunk(table, own)
        lay = layout(table, scheme)
        return finish(table, lay, _covered(lay, answers, scheme, buckets))

    asked = chunks.groupBy(own).applyInArrow(ask, ASKED)
    wanted = asked.groupBy("bucket").applyInArrow(want, WANTED)
    sent = chunks.groupBy(own).cogroup(wanted.groupBy(CHUNK)).applyInArrow(send, SENT)
    answers = asked.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(answer, ANSWERED)
    return chunks.groupBy(own).cogroup(answers.groupBy(CHUNK)).applyInArrow(mark, schema)
