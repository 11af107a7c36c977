"""A context-mixing range coder for sequences of ids.

Ids are coded in blocks, and a block starts from nothing.  In front stand its
ids, most frequent first, with how often each comes.  Then three models say
what they expect before each id:

* order 2 and order 1: the id that last followed the two ids, the one id,
  before, and how often in a row that was right;
* order 0: how frequent an id is in the block.

The id expected by the highest order that knows one is coded as a yes or no.
Its chance is mixed from what all three models have been worth so far, in the
logistic domain, by weights that learn from the outcomes; where all of them
have often said the same, the outcomes of just that case count too.  After a
no the id is coded by its frequency.  Orders 2 and 1 learn with every id,
chances and weights in rounds (``_ROUNDS``).  All is integer arithmetic, so
every machine decodes what any other has coded.

The blocks of a segment are coded side by side: one step codes one id of each,
with numpy.  Blocks remain independent; each has its own checksum.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from tessera.errors import CorruptIndex

#: Ids of a block (their numbers take 12 bits), and blocks that are coded side by side, about.
BLOCK, LANES = 4096, 3072
#: Blocks of a segment, if that leaves blocks of at least ``SHORT`` ids.
WANTED, SHORT = 256, 512

U = np.uint64
#: The width of a coder is of 60 bits at most, 28 at least; 32 bits go out or come in at a time.
_TOP, _BOTTOM, _WORD, _PART, _KEPT = U((1 << 60) - 1), U(1 << 28), U(32), U(16), U(28)
#: Ids after which chances and weights learn, and ids that are handled at once.
_ROUNDS, _STEPS = (32, 128, 256, 512, 1024, 2048), 256
#: Bound of a model's weight, in 65536.
_HEAVY = 300_000
#: Outcomes that the mixed chance of a case weighs.
_PRIOR = 8
_HEAD = struct.Struct("<4sQIIB")
_MAGIC = b"TSB2"

_DOMAIN = 2047
_SQUASH = np.clip(65536 / (1 + np.exp(-np.arange(-_DOMAIN - 1, _DOMAIN + 1) / 256.0)), 32, 65504).astype(np.int64)
_STRETCH = np.clip(np.round(256 * np.log((np.arange(4096) + 0.5) / (4095.5 - np.arange(4096)))), -_DOMAIN, _DOMAIN).astype(np.int64)

_SLOT = (np.arange(BLOCK) << 4).astype(np.uint16)
_FREQUENCY = np.array([((c > 1) + (c > 3) + (c > 15)) << 2 for c in range(BLOCK + 1)], np.uint16)


def _tables_crc() -> int:
    """Differs if a machine's logarithms round otherwise; stored with each segment."""
    return zlib.crc32(_SQUASH.astype("<i8").tobytes() + _STRETCH.astype("<i8").tobytes())


def _names(slot: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What the models call an id: its number in the block, a class of its frequency, two bits for how often it was right."""
    return _SLOT.take(slot) | _FREQUENCY.take(count)


class _Models:
    """What all blocks of a segment have learnt; a row of each table per block."""

    def __init__(self, lanes: int, slots: int, block: int):
        self.lanes, self.mask = lanes, (1 << max(6, (block - 1).bit_length() - 1)) - 1
        lane = np.arange(lanes)
        # what followed: by the two ids before, then by the one
        self.base = np.stack([lane * (self.mask + 1), lanes * (self.mask + 1) + lane * slots])
        self.next = np.zeros(lanes * (self.mask + 1 + slots), np.uint16)
        # a case: agreement of the orders, trust in order 1, frequency, trust in order 2
        self.at_case = lane * 128
        self.chance = np.full(lanes * 128, 1 << 15, U)
        self.seen, self.right = np.zeros(lanes * 128, np.int64), np.zeros(lanes * 128, np.int64)
        self.weight = np.full((3, lanes), 26_000, np.int64)
        self.t = 0

    def places(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where stands what followed, after ids of these numbers."""
        i = np.empty((*last.shape[:-1], 2, self.lanes), np.int64)
        np.add(last * 2_531, before, out=i[..., 0, :])
        i[..., 0, :] &= self.mask
        i[..., 1, :] = last
        i += self.base
        return i

    def learn(self, i: np.ndarray, e: np.ndarray, name: np.ndarray) -> None:
        """Takes in the ids that came where e stood; once they come again, they are trusted more."""
        self.next[i] = np.where((e ^ name) < 4, name | 3, name | 1)

    def cases(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The expected ids, and the cases they are."""
        k = e & 3
        one, k_2, k_1 = e[..., 1, :], k[..., 0, :], k[..., 1, :]
        x = np.where(k_2, e[..., 0, :], one)
        k_1 <<= 4
        k_1 |= k_2
        k_1 |= x & 12
        k_1 |= ((x ^ one) < 4).view(np.uint8) << np.uint16(6)
        return x, self.at_case + k_1

    def round(self, cases: np.ndarray, hits: np.ndarray) -> None:
        """Counts the outcomes of cases, and learns from all so far where a round ends."""
        self.t += len(cases)
        if self.t > _ROUNDS[-1]:
            return
        self.seen += np.bincount(cases.ravel(), minlength=len(self.seen))
        self.right += np.bincount(cases[hits], minlength=len(self.seen))
        if self.t not in _ROUNDS:
            return
        shape = (self.lanes, 2, 4, 4, 4)
        n, h = self.seen.reshape(shape), self.right.reshape(shape)

        def worth(*over: int) -> np.ndarray:
            some, good = n.sum(axis=over, keepdims=True), h.sum(axis=over, keepdims=True)
            return _STRETCH.take((((2 * good + 1) << 15) // (some + 1)) >> 4)

        says = worth(1, 2, 3), worth(3, 4), worth(1, 2, 4)
        self._mix(says, shape)
        miss = (h << 16) - n * self.mixed
        for w, s in zip(self.weight, says, strict=True):
            w += ((miss * s).sum(axis=(1, 2, 3, 4)) // self.t) >> 9
        np.clip(self.weight, -_HEAVY, _HEAVY, out=self.weight)
        self._mix(says, shape)
        chance = (self.mixed * _PRIOR + (h << 16)) // (n + _PRIOR)
        self.chance = np.clip(chance, 32, 65_504).astype(U).ravel()

    def _mix(self, says: tuple[np.ndarray, ...], shape: tuple[int, ...]) -> None:
        a, b, c = (w.reshape(-1, 1, 1, 1, 1) * s for w, s in zip(self.weight, says, strict=True))
        self.mixed = _SQUASH.take(np.clip((a + b + c) >> 16, -_DOMAIN, _DOMAIN) + (_DOMAIN + 1))


def _numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names of ids by step and block, the ids of each block in the order of their numbers, how often each comes, how many a block has."""
    lanes, block = ids.shape
    names, listed, counts, distinct = np.empty((lanes, block), np.uint16), [], [], np.empty(lanes, np.int64)
    change = np.ones(block + 1, bool)
    table = np.empty(1 << 16, np.uint16) if ids.dtype == np.uint16 else None
    for j, row in enumerate(ids):
        ranked = np.sort(row.astype(np.uint32))  # faster than of 16 bits
        change[1:block] = ranked[1:] != ranked[:-1]
        edge = change.nonzero()[0]
        values, count = ranked.take(edge[:-1]), edge[1:] - edge[:-1]
        order = np.argsort((block - count).astype(np.uint16), kind="stable")
        name = np.empty(len(order), np.uint16)
        count = count[order]
        name[order] = _SLOT[: len(order)] | _FREQUENCY.take(count)
        if table is None:
            names[j] = name[np.searchsorted(values, row)]
        else:
            table[values] = name
            names[j] = table.take(row)
        listed.append(values[order])
        counts.append(count)
        distinct[j] = len(order)
    return np.ascontiguousarray(names.T), np.concatenate(listed).astype(ids.dtype), np.concatenate(counts), distinct


def _shares(counts: np.ndarray, block: int) -> np.ndarray:
    """Of each listed id, where its share of the block's frequencies starts, and above 16 bits its size."""
    return ((np.cumsum(counts) - counts) % block | counts << 16).astype(np.uint32)


def _rounds(block: int) -> list[tuple[int, int]]:
    """The parts of a block, from and to."""
    stops = sorted({*(x for x in _ROUNDS if x < block), *range(_STEPS, block, _STEPS), block})
    return [*zip([0, *stops[:-1]], stops, strict=True)]


def _shape(n: int) -> tuple[int, int]:
    """Blocks and ids of a block, for a segment of n ids."""
    block = min(BLOCK, max(SHORT, -(-n // WANTED)))
    return -(-n // block), block


def encode_segment(ids: np.ndarray) -> bytes:
    """Ids (below 2**32) as blocks; the last one is filled up with its last id."""
    n = len(ids)
    kind = np.dtype("<u2" if not n or ids.max() < 1 << 16 else "<u4")
    head = lambda block: _HEAD.pack(_MAGIC, n, block, _tables_crc(), kind.itemsize)
    if not n:
        return head(0)
    lanes, block = _shape(n)
    padded = np.full(lanes * block, ids[-1], kind)
    padded[:n] = ids
    names, listed, counts, distinct = _numbered(padded.reshape(lanes, block))
    lists = np.append(0, np.cumsum(distinct))
    share, at_list = _shares(counts, block), lists[:-1]
    models = _Models(lanes, int(distinct.max()), block)
    low, width = np.zeros(lanes, U), np.full(lanes, _TOP)
    room = block * 24 // 32 + 8  # an id takes 11 bits and 12 at most, and what rounding takes
    words, begin = np.zeros(lanes * room, U), np.arange(lanes) * room
    at, total = begin.copy(), U(block)
    number = np.zeros((2, lanes), np.int64)  # of the two ids before a round
    for a, b in _rounds(block):
        name = names[a:b]
        number = np.concatenate([number, name >> 4])
        i = models.places(number[1:-1], number[:-2])
        own = share.take(number[2:] + at_list)
        number = number[-2:]
        e, once, more = np.empty(i.shape, np.uint16), name | 1, name | 3
        for t in range(b - a):
            was = models.next.take(i[t], out=e[t], mode="clip")
            models.next[i[t]] = np.where((was ^ name[t]) < 4, more[t], once[t])
        expected, case = models.cases(e)
        hits, p = (expected ^ name) < 4, models.chance.take(case)
        models.round(case, hits)
        # the ids' shares lie below, a hit takes what is above all of them
        own = np.where(hits, block, own)
        start, size = (own & 0xFFFF).astype(U), (own >> 16).astype(U)
        for t in range(b - a):
            each = width >> _PART
            each *= p[t]
            np.subtract(width, each, out=each)
            each //= total
            skip = each * start[t]
            low += skip
            width -= skip
            each *= size[t]
            width = np.where(hits[t], width, each)
            full = (width < _BOTTOM).nonzero()[0]
            if len(full):
                place, out = at[full], low[full]
                words[place] = out >> _KEPT  # more than 32 bits where it carries
                at[full] = place + 1
                low[full] = (out & (_BOTTOM - U(1))) << _WORD
                width[full] <<= _WORD
    words[at], words[at + 1] = low >> _KEPT, (low & (_BOTTOM - U(1))) << U(4)
    used = at + 2 - begin
    words = words.reshape(lanes, room)
    while (carry := words >> _WORD).any():
        words &= U(0xFFFFFFFF)
        words[:, :-1] += carry[:, 1:]
    words = words.astype("<u4")
    # ids of one frequency ascend: steps of a byte, or 255 and the id itself
    group = np.append(True, counts[1:] != counts[:-1])
    group[at_list] = True
    step = np.diff(listed.astype(np.int64), prepend=0)
    far = group | (step >= 255)
    steps, whole = np.where(far, 255, step).astype(np.uint8), listed[far]
    wholes = np.append(0, np.cumsum(far))[lists]
    heads = np.flatnonzero(group)
    runs = np.stack([counts[heads], np.diff(heads, append=len(counts))], axis=1).astype("<u2")
    of_run = np.append(0, np.cumsum(group))[lists]
    parts = []
    for j in range(lanes):
        a, b = lists[j], lists[j + 1]
        parts.append(steps[a:b].tobytes() + whole[wholes[j] : wholes[j + 1]].tobytes() + runs[of_run[j] : of_run[j + 1]].tobytes() + words[j, : used[j]].tobytes())
    index = np.stack([distinct, used | np.diff(of_run) << 16], axis=1).astype("<u4").tobytes()
    crc = np.array([zlib.crc32(x) for x in parts], "<u4").tobytes()
    return b"".join([head(block), index, crc, *parts])


def _blocks(data: memoryview, lanes: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each block by number, how often each comes, how many a block has, all words, and where each block's begin."""
    at = _HEAD.size
    if len(data) < at + 12 * lanes:
        raise CorruptIndex("a segment of coded ids is cut short")
    index = np.frombuffer(data, "<u4", 2 * lanes, at).reshape(lanes, 2).astype(np.int64)
    crc = np.frombuffer(data, "<u4", lanes, at + 8 * lanes).tolist()
    at += 12 * lanes
    steps, wholes, runs, words = [], [], [], []
    for j, (distinct, sizes) in enumerate(index.tolist()):
        used, n_runs = sizes & 0xFFFF, sizes >> 16
        step = np.frombuffer(data[at : at + distinct], np.uint8)
        far = int(np.count_nonzero(step == 255))
        stops = np.cumsum([at, distinct, far * width, 4 * n_runs, 4 * used]).tolist()
        if len(data) < stops[-1]:
            raise CorruptIndex("a segment of coded ids is cut short")
        if zlib.crc32(data[at : stops[-1]]) != crc[j]:
            raise CorruptIndex(f"block {j} of a segment has a wrong checksum")
        steps.append(step)
        wholes.append(np.frombuffer(data[stops[1] : stops[2]], f"<u{width}"))
        runs.append(np.frombuffer(data[stops[2] : stops[3]], "<u2").reshape(-1, 2))
        words.append(np.frombuffer(data[stops[3] : stops[4]], "<u4"))
        at = stops[-1]
    step = np.concatenate(steps)
    far, run = step == 255, np.concatenate(runs).astype(np.int64)
    upto = np.cumsum(np.where(far, 0, step).astype(np.int64))
    origin = np.concatenate(wholes).astype(np.int64) - upto[far]
    listed = (upto + np.repeat(origin, np.diff(np.flatnonzero(far), append=len(step)))).astype(np.uint32)
    begin = np.cumsum([len(x) for x in words]) - [len(x) for x in words]
    return listed, np.repeat(run[:, 0], run[:, 1]), index[:, 0], np.concatenate([*words, np.zeros(4, "<u4")]).astype(U), begin


def decode_segment(data: bytes | memoryview) -> np.ndarray:
    """The ids of a segment; raises if a block's checksum is wrong."""
    data = memoryview(data)
    magic, n, block, tables, width_of = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise CorruptIndex("not a segment of coded ids")
    if tables != _tables_crc():
        raise CorruptIndex("coded with other tables than this machine's")
    if not n:
        return np.zeros(0, np.uint32)
    lanes = -(-n // block)
    listed, counts, distinct, words, at = _blocks(data, lanes, width_of)
    at_list = np.cumsum(distinct) - distinct
    number = np.arange(len(listed)) - np.repeat(at_list, distinct)
    # by place among a block's shares: name, start and size; one more stands for a hit
    share = _shares(counts, block).astype(np.int64) << 16 | _names(number, counts)
    table = np.empty((lanes, block + 1), np.int64)
    table[:, :block] = np.repeat(share, counts).reshape(lanes, block)
    table[:, block] = block << 16
    table, at_table = table.ravel(), np.arange(lanes) * (block + 1)
    models = _Models(lanes, int(distinct.max()), block)
    code, width = words[at] << _KEPT | words[at + 1] >> U(4), np.full(lanes, _TOP)
    words = (words[:-1] & U(15)) << _KEPT | words[1:] >> U(4)
    at, total = at + 1, U(block)
    out, keep = np.empty((block, lanes), np.uint16), np.uint16(0xFFFC)
    last = before = np.zeros(lanes, np.int64)
    for a, b in _rounds(block):
        cases, hits = np.empty((b - a, lanes), np.int64), np.empty((b - a, lanes), bool)
        for t in range(b - a):
            i = models.places(last, before)
            e = models.next.take(i)
            expected, case = models.cases(e)
            cases[t] = case
            each = width >> _PART
            each *= models.chance.take(case)
            np.subtract(width, each, out=each)
            each //= total
            place = np.minimum(code // each, total)
            hit = np.equal(place, total, out=hits[t])
            found = table.take(place.view(np.int64) + at_table)
            name = np.where(hit, expected & keep, found.astype(np.uint16))
            found >>= 16
            skip = each * (found & 0xFFFF).view(U)
            found >>= 16
            each *= found.view(U)
            code -= skip
            width -= skip
            width = np.where(hit, width, each)
            need = (width < _BOTTOM).nonzero()[0]
            if len(need):
                place = at[need]
                code[need] = code[need] << _WORD | words[place]
                at[need] = place + 1
                width[need] <<= _WORD
            models.learn(i, e, name)
            out[a + t] = name
            before, last = last, (name >> 4).astype(np.int64)
        models.round(cases, hits)
    out >>= 4
    found = np.empty((lanes, block), np.uint32)
    for own, row, a, b in zip(found, np.ascontiguousarray(out.T), at_list.tolist(), (at_list + distinct).tolist(), strict=True):
        np.take(listed[a:b], row, out=own, mode="clip")
    return found.ravel()[:n]
