"""Ids of whole batches of texts by a table of pieces, in array operations.

A text of ASCII and Latin letters is cut into the pieces of the byte-level
pattern by the classes of its bytes.  A piece of at most 16 bytes is its own
key, as two numbers, so no two pieces are taken for each other.  Keys are
looked up in an open-addressing table; pieces seen for the first time are
merged by tiktoken's core, with the ranks of the same vocabulary, and
remembered, up to a bound.  Longer pieces are kept in a dictionary, or, if very
long, not kept.  Other texts, and those with special tokens, are cut by the
tokenizer library (``token_counts``).
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.token_counts import Bpe, Remembered

#: Pieces remembered by a worker.
REMEMBERED = 1 << 21
#: Bytes of a piece that is remembered, at most.
KEPT = 64

_LETTER, _DIGIT, _OTHER, _SPACE, _WHITE = 1, 2, 3, 4, 5
_U = np.uint64
_MIX = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def _classes() -> np.ndarray:
    """The class of each byte; 0 where Unicode tables would be needed."""
    out = np.zeros(256, np.uint8)
    out[0x21:0x7F] = _OTHER
    for a, b in ("AZ", "az"):
        out[ord(a) : ord(b) + 1] = _LETTER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[9:14], out[32] = _WHITE, _SPACE
    out[0x80:0xC0] = out[0xC3:0xC6] = _LETTER  # of the two-byte letters up to U+017F
    return out


def _begins() -> np.ndarray:
    """Whether a piece starts between two bytes, by 8 * class before + class after."""
    out = np.zeros(64, bool)
    for a in range(6):
        for b in range(6):
            out[8 * a + b] = a != b and a != _SPACE and not (a == _WHITE and b == _SPACE)
    return out


_CLASS, _BEGINS = _classes(), _begins()
_APOSTROPHE = ord("'")


def cut(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and which texts cannot be cut by classes of bytes.

    data: UTF-8 of all texts and two bytes more; edge: where texts start, and the end.
    """
    n = int(edge[-1])
    kind = _CLASS[data[:n]]
    full = edge[:-1] < edge[1:]
    first, final = edge[:-1][full], edge[1:][full] - 1
    # multiplication and division signs stand among the Latin letters
    odd = np.flatnonzero((kind == 0) | (data[:n] == 0xC3) & ((data[1 : n + 1] == 0x97) | (data[1 : n + 1] == 0xB7)))
    unusual = np.zeros(len(edge) - 1, bool)
    unusual[np.searchsorted(edge, odd, side="right") - 1] = True
    start = np.empty(n, bool)
    start[1:] = _BEGINS[(kind[:-1] << 3) | kind[1:]]
    # the last of a run of white space stands alone or goes with what follows, but not at a text's end
    turn = np.zeros(n, bool)
    turn[:-1] = (kind[:-1] >= _SPACE) & (kind[1:] < _SPACE)
    turn[final] = False
    start |= turn
    start[first] = True
    at = np.flatnonzero(data[:n] == _APOSTROPHE)
    if len(at):
        before = np.where(start[at], kind[at - 1], _OTHER)
        before[np.isin(at, first)] = _LETTER
        at = at[(before != _OTHER) & (before != _SPACE)]
        stop = edge[np.searchsorted(edge, at, side="right")]
        a, b = data[at + 1], data[at + 2]
        two = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (at + 1 < stop)
        three = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (at + 2 < stop)
        start[at[two | three] + 1] = False
        for which, size in ((two, 2), (three, 3)):
            after = at[which & (at + size < stop)] + size
            start[after] = True
    return np.flatnonzero(start), unusual


class PieceTable:
    """Ids of pieces that this worker has seen."""

    def __init__(self, model: Bpe, end: int, remembered: int = REMEMBERED):
        import tiktoken

        # of a vocabulary whose ids ascend as its merges do, the ids are ranks
        if not (np.diff(model.merged) > 0).all():
            raise ValueError(f"the ids of {model.path} are not in the order of its merges")
        ranks = {bytes(model.bytes_of[c] for c in name): i for name, i in model.vocab.items() if name not in model.special}
        self.merge = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.whole, self.end, self.remembered = Remembered(model, True), end, remembered
        self.widest = max(end, *model.vocab.values(), *model.special.values())
        self._clear()

    def _clear(self) -> None:
        self.bits = 12
        self.key, self.key_2, self.number = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, np.int32)
        self.long: dict[bytes, int] = {}
        self.words = self.used = 0
        self.ids, self.at, self.count = np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.end_word = int(self._add([self.end], [1])[0])

    def _add(self, ids: list[int], count: list[int]) -> np.ndarray:
        """Numbers of new words with these ids."""
        n, m = len(ids), len(count)
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.used + n, np.uint32)])
        if self.words + m > len(self.at):
            more = np.zeros(self.words + m, np.int64)
            self.at, self.count = np.concatenate([self.at, more]), np.concatenate([self.count, more])
        size = np.array(count, np.int64)
        self.ids[self.used : self.used + n] = ids
        self.at[self.words : self.words + m] = self.used + np.cumsum(size) - size
        self.count[self.words : self.words + m] = size
        self.used, self.words = self.used + n, self.words + m
        return np.arange(self.words - m, self.words)

    def _encode(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of new words."""
        found = [*map(self.merge, pieces)]
        return self._add([*chain.from_iterable(found)], [*map(len, found)])

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a * _MIX[0]) ^ (b * _MIX[1])
        mixed ^= mixed >> _U(32)
        return ((mixed * _MIX[2]) >> _U(64 - self.bits)).astype(np.int64)

    def _put(self, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        """Enters keys that are not there; each comes once."""
        last, slot = (1 << self.bits) - 1, self._slot(a, b)
        while len(slot):
            free = self.key[slot] == 0
            own = np.flatnonzero(free)
            self.number[slot[own]] = number[own]
            own = own[self.number[slot[own]] == number[own]]
            self.key[slot[own]], self.key_2[slot[own]] = a[own], b[own]
            rest = np.ones(len(slot), bool)
            rest[own] = False
            a, b, number, slot = a[rest], b[rest], number[rest], (slot[rest] + 1) & last

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Numbers of the words with these keys, or -1."""
        last, slot = (1 << self.bits) - 1, self._slot(a, b)
        key = self.key.take(slot)
        same = (key == a) & (self.key_2.take(slot) == b)
        out = np.where(same, self.number.take(slot), -1)
        who = np.flatnonzero(~same & (key != 0))
        slot = slot[who]
        while len(who):
            slot = (slot + 1) & last
            key = self.key[slot]
            same = (key == a[who]) & (self.key_2[slot] == b[who])
            out[who[same]] = self.number[slot[same]]
            on = ~same & (key != 0)
            who, slot = who[on], slot[on]
        return out

    def _short(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of pieces of at most 16 bytes; data has 16 bytes more than the texts."""
        eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
        a = eight[start] & _MASK.take(np.minimum(size, 8))
        b = np.zeros(len(start), _U)
        more = np.flatnonzero(size > 8)
        b[more] = eight[start[more] + 8] & _MASK.take(size[more] - 8)
        out = self._find(a, b)
        new = np.flatnonzero(out < 0)
        if len(new):
            x, y = a[new], b[new]
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            lead = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            once = new[order[lead]]
            raw = data.tobytes()
            number = self._encode([raw[i:j] for i, j in zip(start[once].tolist(), (start[once] + size[once]).tolist(), strict=True)])
            if 2 * self.words > 1 << self.bits:
                old = self.key != 0
                keys = self.key[old], self.key_2[old], self.number[old]
                self.bits = (2 * self.words).bit_length()
                self.key, self.key_2, self.number = np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, _U), np.zeros(1 << self.bits, np.int32)
                self._put(*keys)
            self._put(x[lead], y[lead], number)
            out[new[order]] = number[np.cumsum(lead) - 1]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end mark, and how many each has; null is empty."""
        if self.words > self.remembered:
            self._clear()
        texts = texts.fill_null("").cast(pa.large_string())
        edge = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        data = np.zeros(int(edge[-1] - edge[0]) + 24, np.uint8)
        if edge[-1] > edge[0]:
            data[: edge[-1] - edge[0]] = np.frombuffer(texts.buffers()[2], np.uint8, int(edge[-1] - edge[0]), int(edge[0]))
        edge = edge - edge[0]
        whole = np.zeros(len(texts), bool)
        if len(data) > 24:
            start, whole = cut(data, edge)
            for x in self.whole.model.special:
                whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        else:
            start = np.zeros(0, np.int64)
        bound = np.searchsorted(start, edge)  # pieces before each text
        size = np.diff(start, append=edge[-1])
        if whole.any():
            cut_up = np.repeat(~whole, np.diff(bound))
            start, size = start[cut_up], size[cut_up]
            bound = np.append(0, np.cumsum(np.where(whole, 0, np.diff(bound))))
        number = np.empty(len(start), np.int64)
        fits = size <= 16
        short = np.flatnonzero(fits)
        number[short] = self._short(data, start[short], size[short])
        far = np.flatnonzero(~fits)
        if len(far):
            raw = [data[i : i + k].tobytes() for i, k in zip(start[far].tolist(), size[far].tolist(), strict=True)]
            new = [x for x in dict.fromkeys(raw) if len(x) <= KEPT and x not in self.long]
            self.long.update(zip(new, self._encode(new).tolist(), strict=True))
        words, used = self.words, self.used
        if len(far):
            once = [x for x in dict.fromkeys(raw) if len(x) > KEPT]
            known = dict(zip(once, self._encode(once).tolist(), strict=True))
            number[far] = [known[x] if len(x) > KEPT else self.long[x] for x in raw]
        where, what = bound[1:], np.full(len(texts), self.end_word)
        if whole.any():
            odd = np.flatnonzero(whole)
            pieces = [self.whole.model.pieces(x) for x in texts.take(pa.array(odd)).to_pylist()]
            known = self.whole.learn(pieces)
            found = [np.frombuffer(b"".join(map(known.__getitem__, x)), "<u4") for x in pieces]
            own = self._add(np.concatenate(found), [len(x) for x in found])
            where, what = np.insert(where, odd, bound[1:][odd]), np.insert(what, odd, own)
        number = np.insert(number, where, what)
        count = self.count.take(number)
        before = np.cumsum(count)
        ids = self.ids.take(np.repeat(self.at.take(number) - (before - count), count) + np.arange(before[-1] if len(before) else 0))
        per_text = np.diff(before[number == self.end_word], prepend=0)
        self.words, self.used = words, used
        return ids, per_text
