"""Jaccard self-join of documents on word shingles by PartEnum signatures.

Two sets link when their similarity is at least ``part / whole``.  Sets fall
into bands of about equal size; linked sets lie in the same or in neighbouring
bands and differ in at most K elements, K known per band.  The domain of
elements is split by hash into parts of two subparts, more than K // 2 parts,
and a signature is what a set has in all but one subpart of a part.  It takes
two differences to spoil both signatures of a part, so linked sets share one in
each of the other parts.  A set that has fewer parts with an empty subpart than
it must share parts needs no empty signature; only other sets send them.  Then
either one shared signature is not empty, or both sets send empty ones: no link
is lost, and sets without a common element hardly ever share a signature.

1. One pass over the texts makes the sets and sends signatures, packed, to
   buckets; equal sets send theirs once per batch and count as one *class*.
2. A bucket sorts its signatures.  Classes that share one are candidates: all
   pairs of a small group; of a larger group, its members with its first.
3. Sets of candidates are rebuilt from the text of one document per class,
   and again where they are compared: what is stored and moved are compressed
   texts, which are a fraction of their sets.  Sketches (elements by hash bucket, 260 bytes) drop pairs of small groups
   that differ too much; the others are verified on their sets, in cells.
4. Larger groups are named by their least member, so that those of one source
   of near copies mostly get few names; groups of one name meet in one *crowd*,
   each member once.  A crowd is dealt into blocks of bounded size and any two
   blocks meet in a cell.  A cell holds its sets as differences from what most
   of them have, which are short among near copies, finds all links by them and
   returns a forest: fewer links than members, however many pairs link.  The
   distance of two sets is that of their differences, so the result is exact.
   A cell compares inside its task: the work of a crowd grows with the square
   of its blocks, its rows with members times blocks.
5. Links give components.

Defined results: null or empty text, or one without words, has an empty set,
which links with nothing; fewer words than a shingle make one shingle; a null
id takes part, but a component is named by the smallest id that is not null;
repeated rows link with each other.  An empty table gives no rows.  Other
columns are ignored.  A very long text is one set, handled whole in one task
(about 40 bytes a byte of text at its peak).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.components import connected_components
from tessera.llm.spark_util import checkpointed, columns_of, compressed, fresh, length_of, restored, sieved
from tessera.llm.windows import NO_ID

#: Documents of a kernel call; element keys hold their number in ten bits.
DOCS = 1000
SLICE = 1 << 20
_ELEMENT = np.uint64(54)
_LOW = (np.uint64(1) << _ELEMENT) - np.uint64(1)
#: Groups of at most so many classes give all their pairs at once.
SMALL = 8
#: Buckets of a sketch.
SKETCH = 256
#: Elements of a block of a crowd.
BLOCK = 1 << 19


class Similarity(NamedTuple):
    """Words of a shingle, and the least similarity as a ratio of whole numbers."""

    words: int = 3
    part: int = 90
    whole: int = 100


class Sets(NamedTuple):
    """Sorted distinct elements of all documents, bounds by document, and a hash of each set (0: empty)."""

    elements: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Sets:
    """Sets of at most ``DOCS`` documents."""
    data = K.lower_ascii(data)
    starts, ends, first = K.segment(data, offsets)
    own = K.word_hashes(data, starts, ends)
    n = len(offsets) - 1
    count = np.diff(first)
    sums = K.prefix_sums(own)
    at = np.arange(len(own))
    doc = np.repeat(np.arange(n), count)
    last = first[doc + 1] if len(doc) else at
    whole = at + words <= last
    short = (at == first[doc]) & (last - at < words) if len(doc) else whole
    begin = at[whole | short]
    grams = K.range_hashes(own, begin, np.minimum(begin + words, last[begin]), sums)
    keys = (doc[begin].astype(np.uint64) << _ELEMENT) | (grams & _LOW)
    keys.sort()
    keys = keys[K.group_starts(keys)]
    bounds = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << _ELEMENT)
    elements = keys & _LOW
    total = np.append(np.uint64(0), np.cumsum(K.mix(elements)))
    size = np.diff(bounds)
    hashes = K.mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return Sets(elements, bounds, np.where(size > 0, np.maximum(hashes, np.uint64(1)), np.uint64(0)))


def sketches(sets: Sets) -> np.ndarray:
    """Size of each set (four bytes) and its elements by hash bucket, up to 255 (a byte each).

    Sets differ in at least as many elements as their sketches do.
    """
    n, size = len(sets.bounds) - 1, np.diff(sets.bounds)
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * SKETCH + (sets.elements % np.uint64(SKETCH)).astype(np.int64), minlength=n * SKETCH)
    return np.hstack([size.astype("<u4").view(np.uint8).reshape(n, 4), np.minimum(counts, 255).astype(np.uint8).reshape(n, SKETCH)])


def read_sketches(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and counts."""
    rows = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 4 + SKETCH)
    return np.ascontiguousarray(rows[:, :4]).view("<u4").ravel().astype(np.int64), rows[:, 4:].astype(np.int16)


def bands(largest: int, how: Similarity) -> np.ndarray:
    """The smallest size of each band; the last is above ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * how.whole // how.part + 1)
    edges.append(edges[-1] * how.whole // how.part + 1)
    return np.array(edges, np.int64)


def differences(size: np.ndarray, how: Similarity) -> np.ndarray:
    """Most elements by which linked sets of at most this size can differ."""
    return 2 * size * (how.whole - how.part) // (how.whole + how.part)


def signatures(sets: Sets, how: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the document of each."""
    size = np.diff(sets.bounds)
    edges = bands(int(size.max()) if len(size) else 0, how)
    band = np.searchsorted(edges, size, side="right") - 1
    doc_of = np.repeat(np.arange(len(size)), size)
    mixed = K.mix(sets.elements ^ np.uint64(0x5851F42D4C957F2D))
    out, who = [], []
    for step in (0, 1):
        instance = band + step
        top = edges[np.minimum(instance + 1, len(edges) - 1)] - 1
        most = differences(top, how)
        own_most = (size + np.minimum(top, size * how.whole // how.part)) * (how.whole - how.part) // (how.whole + how.part)
        use = (size > 0) & (most > 0)
        if not use.any():
            continue
        spare = 2 + most // 12
        n1 = np.where(use, most // 2 + 1 + spare, 0)
        base = np.append(0, np.cumsum(n1 * 2))
        chosen = use[doc_of]
        cells = (n1 * 2)[doc_of[chosen]].astype(np.uint64)
        sub = ((sets.elements[chosen] >> np.uint64(22)) * cells) >> np.uint64(32)
        count = np.bincount(base[doc_of[chosen]] + sub.astype(np.int64), minlength=base[-1])
        ends = np.cumsum(count)
        # elements are sorted by document and value, so those of a subpart are neighbours
        total = np.append(np.uint64(0), np.cumsum(mixed[chosen]))
        values = (total[ends] - total[ends - count]).reshape(-1, 2)
        count = count.reshape(-1, 2)
        doc = np.repeat(np.arange(len(size)), n1)
        part = np.arange(len(doc)) - base[doc] // 2
        bare = np.bincount(doc, weights=(count == 0).any(axis=1), minlength=len(size)) >= n1 - own_most // 2
        salt = K.mix(instance[doc].astype(np.uint64) << np.uint64(32) | part.astype(np.uint64))
        for left_out in (0, 1):
            told = (count[:, 1 - left_out] > 0) | bare[doc]
            out.append(K.mix(values[told, 1 - left_out] ^ K.mix(salt[told] + np.uint64(left_out + 1))))
            who.append(doc[told])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out), np.concatenate(who)) if out else (none.astype(np.uint64), none)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    from tessera.llm.token_counts import batches_of

    for piece in batches_of(batch, limit=SLICE):
        for i in range(0, piece.num_rows, DOCS):
            yield piece.slice(i, DOCS)


#: Sizes of sets in a byte: the least size of each step.
STEPS = np.unique(np.maximum(np.arange(1, 257), np.floor(1.1 ** np.arange(256)))).astype(np.int64)


def size_steps(size: np.ndarray) -> np.ndarray:
    """The step of each size, a byte."""
    return np.maximum(np.searchsorted(STEPS, size, side="right") - 1, 0).astype(np.uint8)


_SENT = "bucket long, ids binary, sizes binary, sets binary, signature binary, owner binary, owner_step binary"


def _sender(how: Similarity, buckets: int):
    """Profiles of documents and signatures of distinct sets, packed by bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in (part for whole in batches for part in _parts(whole)):
            sets = shingle_sets(*K.text_buffer(batch.column("text")), how.words)
            size = np.diff(sets.bounds)
            ids = batch.column("doc_id").to_numpy()
            _, firsts = np.unique(sets.hashes, return_index=True)
            only = np.zeros(len(ids), bool)
            only[firsts] = True
            signature, doc = signatures(sets, how)
            keep = only[doc]
            signature, doc = signature[keep], doc[keep]
            bucket = (signature % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((doc, bucket))  # equal owners stand together
            signature, doc, bucket = (signature[order] >> np.uint64(32)).astype(np.uint32), doc[order], bucket[order]
            starts, step = K.group_starts(bucket), size_steps(size)
            edge = np.append(starts, len(bucket))
            rows = [(int(bucket[i]), b"", b"", b"", signature[i:j].tobytes(), sets.hashes[doc[i:j]].tobytes(), step[doc[i:j]].tobytes()) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            number += 1
            rows.append(((int(ids[0]) + number) % buckets, ids.tobytes(), size.tobytes(), sets.hashes.tobytes(), b"", b"", b""))
            kinds = [pa.int64(), *[pa.binary()] * 6]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _SENT.split(", ")])

    return send


PROFILE, PAIR, GROUP = range(3)
_FOUND = "kind int, x long, y long, z long"


def _found(kind: int, x, y, z) -> pa.Table:
    column = lambda v: pa.array(np.asarray(v).astype(np.uint64).view(np.int64) if np.asarray(v).dtype == np.uint64 else np.asarray(v, np.int64))
    return pa.table({"kind": pa.array(np.full(len(x), kind), pa.int32()), "x": column(x), "y": column(y), "z": column(z)})


def candidates(signature: np.ndarray, owner: np.ndarray, step: np.ndarray, how: Similarity, most: int) -> list[pa.Table]:
    """Pairs of classes in small groups, each with the place where to verify it; members of larger groups with their first.

    step: of the size of each owner's set; pairs stay if sizes of their steps allow a link.
    The place is named by the group's first class, so that classes which are
    candidates of each other meet in few places.
    """
    order = np.lexsort((owner, signature))
    signature, owner, step = signature[order], owner[order], step[order].astype(np.int64)
    once = K.group_starts(signature, owner)
    signature, owner, step = signature[once], owner[once], step[once]
    start = K.group_starts(signature)
    many = np.diff(np.append(start, len(signature)))
    group = np.repeat(np.arange(len(start)), many)
    left, right, homes = [], [], []
    small = np.repeat((many > 1) & (many <= most), many)
    s_owner, s_step, s_group = owner[small], step[small], group[small]
    largest = np.append(STEPS[1:] - 1, 1 << 40)
    s_home = owner[start[s_group]]
    for d in range(1, min(most, len(s_owner))):
        i = np.flatnonzero(s_group[:-d] == s_group[d:])
        if not len(i):
            break
        low, high = np.minimum(s_step[i], s_step[i + d]), np.maximum(s_step[i], s_step[i + d])
        i = i[largest[low] * how.whole >= STEPS[high] * how.part]
        left.append(s_owner[i])
        right.append(s_owner[i + d])
        homes.append(s_home[i])
    out, seen = [], set()
    for g in np.flatnonzero(many > most).tolist():
        own = owner[start[g] : start[g] + many[g]]
        name = int(np.bitwise_xor.reduce(K.mix(own)) ^ np.uint64(len(own)))
        if name in seen:
            continue
        seen.add(name)
        out.append(_found(GROUP, np.full(len(own), own[0]), own, np.zeros(len(own))))
    if left:
        a, b, home = np.concatenate(left), np.concatenate(right), np.concatenate(homes)
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((home, b, a))
        a, b, home = a[order], b[order], home[order]
        once = K.group_starts(a, b)
        out.append(_found(PAIR, a[once], b[once], home[once]))
    return out


def _bucket(how: Similarity, most: int):
    def find(table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        ids, sizes, sets = joined("ids", np.int64), joined("sizes", np.int64), joined("sets", np.uint64)
        parts = [_found(PROFILE, ids, sizes, sets)]
        parts += candidates(joined("signature", np.uint32), joined("owner", np.uint64), joined("owner_step", np.uint8), how, most)
        return pa.concat_tables(parts)

    return find


def _unpacked(packed: pa.ChunkedArray, how: Similarity) -> list[np.ndarray]:
    """The sets of compressed texts."""
    out: list[np.ndarray] = []
    texts: list[bytes] = []
    held = 0

    def turn() -> None:
        sets = shingle_sets(*K.text_buffer(pa.array(texts, pa.binary())), how.words)
        out.extend(sets.elements[a:b] for a, b in zip(sets.bounds[:-1], sets.bounds[1:], strict=True))
        texts.clear()

    for x in packed.to_pylist():
        n = length_of(x)
        if texts and (held + n > SLICE or len(texts) == DOCS):
            turn()
            held = 0
        texts.append(restored(x))
        held += n
    if texts:
        turn()
    return out


def _rebuild(how: Similarity):
    """Sketches and texts, compressed, of the documents that have a set."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            sets = shingle_sets(*K.text_buffer(batch.column("text")), how.words)
            _, keep = np.unique(sets.hashes, return_index=True)
            keep = keep[sets.hashes[keep] > 0]
            text = batch.column("text")
            packed = [compressed(text[int(i)].as_buffer()) for i in keep]
            sketch = [x.tobytes() for x in sketches(sets)[keep]]
            yield pa.record_batch({"node": pa.array(sets.hashes.view(np.int64)[keep]), "sketch": pa.array(sketch, pa.binary()), "packed": pa.array(packed, pa.binary())})

    return rebuild


def _sets_of(texts: DataFrame, nodes: DataFrame, profiles: DataFrame, how: Similarity) -> DataFrame:
    """node, sketch, packed of nodes (node, least), from the texts of one document each; others, and some twice, may be among them.

    Documents are found where they are: no text is moved for it.
    """
    ids = checkpointed(nodes.select(F.col("least").alias("doc_id")).distinct())
    rebuilt = sieved(texts, "doc_id", ids).mapInArrow(_rebuild(how), "node long, sketch binary, packed binary")
    repeated = profiles.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1")
    return rebuilt if repeated.isEmpty() else rebuilt.dropDuplicates(["node"])


def _verifier(how: Similarity):
    """Links of a cell that join what its other links have not joined."""

    def verify(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        a, b = pairs["a"].to_pylist(), pairs["b"].to_pylist()
        elements = dict(zip(sets["node"].to_pylist(), _unpacked(sets["packed"], how), strict=True))
        parent = {n: n for n in elements}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for x, y in zip(a, b, strict=True):
            if x not in parent or y not in parent or (rx := root(x)) == (ry := root(y)):
                continue
            p, q = elements[x], elements[y]
            if len(p) > len(q):
                p, q = q, p
            if len(p) * how.whole < len(q) * how.part:
                continue
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            common = int(np.count_nonzero(q[at] == p))
            if common * how.whole >= (len(p) + len(q) - common) * how.part:
                parent[rx] = ry
                links.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return verify


def forest(sets: list[np.ndarray], block: np.ndarray, how: Similarity) -> list[tuple[int, int]]:
    """Links that join what links, among sets of one block, or else between the sets of two.

    x and y differ in |dx| + |dy| - 2 |dx and dy| elements, where dx is what x
    differs in from the elements that most sets have.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    member = np.repeat(np.arange(n), size)
    values, element = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(element, minlength=len(values)) * 2 > n
    place = np.cumsum(common) - 1
    has = np.zeros((n, int(common.sum())), bool)
    shared = common[element]
    has[member[shared], place[element[shared]]] = True
    lacks, which = np.nonzero(~has)
    element = np.concatenate([element[~shared], np.flatnonzero(common)[which]])
    member = np.concatenate([member[~shared], lacks])
    apart = np.bincount(member, minlength=n)
    by = np.argsort(element, kind="stable")
    holders, first = member[by], np.searchsorted(element[by], np.arange(len(values) + 1))
    by = np.argsort(member, kind="stable")
    own, bounds = element[by], np.append(0, np.cumsum(apart))
    label, links = np.arange(n), []
    other = np.ones(n, bool) if (block == block[0]).all() else block != block[0]
    for i in range(n) if other.all() else np.flatnonzero(~other).tolist():
        open_ = other & (label != label[i])
        if not open_.any():
            continue
        e = own[bounds[i] : bounds[i + 1]]
        count = first[e + 1] - first[e]
        at = np.arange(count.sum()) + np.repeat(first[e] - np.append(0, np.cumsum(count))[:-1], count)
        both = np.bincount(holders[at], minlength=n)
        near = (apart + apart[i] - 2 * both) * (how.whole + how.part) <= (size + size[i]) * (how.whole - how.part)
        for j in np.flatnonzero(near & open_).tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def _cell(how: Similarity):
    """Links of one cell of a crowd."""

    def find(table: pa.Table) -> pa.Table:
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        node, once = np.unique(node, return_index=True)
        links = forest(_unpacked(table["packed"].take(pa.array(once)), how), block[once], how)
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[at[:, 0]]), "b": pa.array(node[at[:, 1]])})

    return find


def _crowd_links(groups: DataFrame, classes: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """Links (a, b) within the larger groups, which are given as (crowd, node)."""
    members = checkpointed(groups.distinct().join(classes.select("node", "n_shingles"), "node"))
    blocks = members.groupBy("crowd").agg(F.ceil(F.sum("n_shingles") / BLOCK).alias("blocks"))
    placed = members.join(blocks, "crowd").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    cells = F.expr("transform(sequence(0L, blocks - 1), o -> named_struct('low', least(block, o), 'high', greatest(block, o)))")
    placed = placed.select("crowd", "node", "block", F.explode(cells).alias("cell")).select("crowd", "node", "block", "cell.low", "cell.high")
    return placed.join(sets.select("node", "packed"), "node").groupBy("crowd", "low", "high").applyInArrow(_cell(how), "a long, b long")


def _sifter(how: Similarity):
    """Pairs of a cell whose sketches allow a link."""

    def sift(pairs: pa.Table, sketched: pa.Table) -> pa.Table:
        pairs = pairs.combine_chunks()
        node = sketched["node"].to_numpy()
        order = np.argsort(node, kind="stable")
        size, sketch = read_sketches(sketched["packed"].to_pylist())
        size, sketch, node = size[order], sketch[order], node[order]
        a, b = (np.searchsorted(node, pairs[c].to_numpy()) for c in ("a", "b"))
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), 4096):
            x, y = a[i : i + 4096], b[i : i + 4096]
            apart = np.abs(sketch[x] - sketch[y]).sum(axis=1, dtype=np.int64)
            keep[i : i + 4096] = apart * (how.whole + how.part) <= (size[x] + size[y]) * (how.whole - how.part)
        return pairs.filter(pa.array(keep)).select(["a", "b", "home"])

    return sift


def _in_cells(pairs: DataFrame, rows: DataFrame, cells: int, run, schema: str) -> DataFrame:
    """``run`` of the pairs (a, b, home) of each cell and the rows (node, packed) that they name."""
    dealt = pairs.select(F.pmod(F.xxhash64("home"), F.lit(cells)).alias("cell"), "a", "b", "home")
    needed = dealt.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct()
    told = needed.join(sieved(rows, "node", needed.select("node")), "node").select(F.col("cell").alias("at"), "node", "packed")
    return dealt.groupBy("cell").cogroup(told.groupBy("at")).applyInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, how: Similarity, cells: int) -> DataFrame:
    """Links among pairs of nodes; sets has node, packed elements."""
    return _in_cells(pairs, sets, cells, _verifier(how), "a long, b long")


class Classes(NamedTuple):
    """Of every row its doc_id, n_shingles and node (0: no set); of every node with a link its component; the least id of every node."""

    profiles: DataFrame
    components: DataFrame
    classes: DataFrame


def _link(docs: DataFrame, how: Similarity) -> Classes:
    """Classes of equal sets, named by the hash of the set, and how they link."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(_known_id().alias("doc_id"), "text")
    sent = texts.mapInArrow(_sender(how, buckets), _SENT)
    found = checkpointed(sent.groupBy("bucket").applyInArrow(_bucket(how, SMALL), _FOUND))
    profiles = found.where(F.col("kind") == PROFILE).select(F.col("x").alias("doc_id"), F.col("y").alias("n_shingles"), F.col("z").alias("node"))
    classes = profiles.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"))
    pairs = found.where(F.col("kind") == PAIR).groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.min("z").alias("home"))
    groups = found.where(F.col("kind") == GROUP).select(F.col("x").alias("crowd"), F.col("y").alias("node"))
    components = spark.createDataFrame([], "node long, component long")
    if not pairs.isEmpty() or not groups.isEmpty():
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(groups.select("node")).distinct()
        sets = checkpointed(_sets_of(texts, ends.join(classes, "node"), profiles, how))
        sifted = checkpointed(_in_cells(pairs, sets.select("node", F.col("sketch").alias("packed")), 4 * buckets, _sifter(how), "a long, b long, home long"))
        links = _in_cells(sifted, sets.select("node", "packed"), 4 * buckets, _verifier(how), "a long, b long")
        if not groups.isEmpty():
            links = links.union(_crowd_links(groups, classes, sets, how))
        components = checkpointed(connected_components(links))
    return Classes(profiles, components, classes)


def _known_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID)))


def jaccard_components(docs: DataFrame, how: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    profiles, components, classes = _link(docs, how)
    names = classes.join(components, "node").groupBy("component").agg(F.min("least").alias("name"))
    linked = components.join(names, "component").select("node", "name")
    clean = lambda c: F.when(c != NO_ID, c)
    alone = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return (
        profiles.join(classes.select("node", "least"), "node", "left")
        .join(linked, "node", "left")
        .select(clean(F.col("doc_id")).alias("doc_id"), "n_shingles", clean(F.coalesce("name", alone)).alias("component_id"))
    )


def _with_node(docs: DataFrame, name: str, how: Similarity) -> DataFrame:
    """docs and the hash of each row's set (0: no set)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            node = shingle_sets(*K.text_buffer(batch.column("text")), how.words).hashes.view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], [*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def one_of_each(docs: DataFrame, how: Similarity) -> DataFrame:
    """docs with one row of each component: the one of the smallest id, null after all others.

    Rows are told apart by id and set, so rows of one id whose texts do not
    link are judged one by one; of rows equal in both, any one stays.  Rows
    without words have no set and stay, all of them.  Only ids that repeat need
    their rows' sets once more; all other rows go by id.
    """
    profiles, components, classes = _link(docs, how)
    nodes = classes.select("node", "least").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = nodes.groupBy("component").agg(F.min(F.struct("least", "node")).alias("best")).select("best.*")
    rows = profiles.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    stay = best.select(F.col("least").alias("doc_id"), "node")
    node, key = fresh(docs, "node"), fresh(docs, "key")
    drop = checkpointed(rows.where("n = 1 AND node <> 0").join(stay, ["doc_id", "node"], "left_anti").select(F.col("doc_id").alias(key)))
    several = checkpointed(rows.where("n > 1").select(F.col("doc_id").alias(key)))
    keyed = docs.withColumn(key, _known_id())
    if several.isEmpty():
        return _without(keyed, key, drop).select(*columns_of(docs))
    plain = _without(keyed, key, several.unionByName(drop)).select(*columns_of(docs))
    told = _with_node(sieved(keyed, key, several).select(*columns_of(docs)), node, how).withColumn(key, _known_id()).join(several, key, "left_semi")
    empty = told.where(F.col(node) == 0)
    once = told.join(stay.select(F.col("doc_id").alias(key), F.col("node").alias(node)), [key, node], "left_semi").dropDuplicates([node])
    return plain.unionByName(empty.select(*columns_of(docs))).unionByName(once.select(*columns_of(docs)))


def _without(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is not among keys; only the few that may be are moved."""
    return sieved(rows, key, keys, inside=False).unionByName(sieved(rows, key, keys).join(keys, key, "left_anti").select(*columns_of(rows)))
