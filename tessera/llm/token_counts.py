"""Token counts by rank-synchronous merging of arrays.

Pre-tokens are kept as ragged numpy arrays of symbols.  In each round every
sequence finds its pair of lowest rank and merges all places of that pair at
once, from left to right; sequences without a known pair are finished and
leave.  The surviving symbols are the tokens.  Rounds are shared by all
sequences of a batch, so the work per round is a handful of array operations.

Pre-tokens repeat, so each Python worker keeps the results of those it has
seen, in a table of bounded size.  Texts of Latin letters and ASCII are split
by one compiled pattern; any other text is normalised and split by the
tokenizer library's own components, so the pieces are the library's.

Defined results: null text is empty and has 0 bytes and tokens; strings of
special tokens count as the library's default treats them, as one token.  Texts
are counted whole, however long.  An
empty table gives no rows.  Other columns pass through; those of the result
replace any of the same name.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.suffix_dedup import result_schema, with_columns

#: Documents longer than this are over the limit.
LIMIT = 2048
#: Pre-tokens remembered by a worker.
REMEMBERED = 400_000
#: Bytes of text handled at once.
SLICE = 1 << 20

_NONE = np.int32(np.iinfo(np.int32).max)

# Letters and other characters that need no Unicode tables.
_LETTERS = "a-zß-öø-įı-ſ"
_UNUSUAL = re.compile("[^\t-\r -~À-ÖØ-öø-įı-ſ]")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + extra)
            extra += 1
    return [names[b] for b in range(256)]


class Bpe:
    """A byte-level BPE with word ends, read from a tokenizer's JSON file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, end = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab, names = model["vocab"], _byte_names()
        self.vocab = vocab
        self.bytes_of = {name: b for b, name in enumerate(names)}
        self.inner = np.array([vocab[x] for x in names], np.int32)
        self.final = np.array([vocab[x + end] for x in names], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pair = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank = pair[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.is_special = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None

    @functools.cached_property
    def library(self):
        """The tokenizer library's object, loaded when a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens of a text, as words; special tokens as their ids."""
        if self.is_special is None:
            return self._words(text)
        out, at = [], 0
        for found in self.is_special.finditer(text):
            out += self._words(text[at : found.start()])
            out.append(self.special[found[0]])
            at = found.end()
        return out + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        if _UNUSUAL.search(text) is None:
            return _PIECES.findall(text.lower())
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        named = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(self.bytes_of[c] for c in word).decode("utf-8", "surrogateescape") for word, _ in named]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NONE)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        length = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        last = np.zeros(len(data), bool)
        last[np.cumsum(length) - 1] = True
        symbol = np.where(last, self.final[data], self.inner[data])
        rank = np.full(len(symbol), _NONE)
        open_ = np.flatnonzero(~last)
        rank[open_] = self.ranks(symbol[open_], symbol[open_ + 1])
        count = np.empty(len(words), np.int64)
        who, done_ids, done_who = np.arange(len(words)), [], []
        while len(symbol):
            stop = np.flatnonzero(last) + 1
            start = np.append(0, stop[:-1])
            size = stop - start
            lowest = np.minimum.reduceat(rank, start)
            finished = lowest == _NONE
            if finished.any():
                count[who[finished]] = size[finished]
                out = np.repeat(finished, size)
                done_ids.append(symbol[out])
                done_who.append(who[finished])
                symbol, rank, last = symbol[~out], rank[~out], last[~out]
                who, size, lowest = who[~finished], size[~finished], lowest[~finished]
                if not len(symbol):
                    break
            low = np.repeat(lowest, size)
            here = np.flatnonzero(rank == low)
            # of places in a row ("aaa") every other one merges
            run = np.append(0, np.flatnonzero(np.diff(here) != 1) + 1)
            inner = np.arange(len(here)) - np.repeat(here[run] * 0 + run, np.diff(np.append(run, len(here))))
            here = here[inner % 2 == 0]
            symbol[here] = self.merged[low[here]]
            last[here] = last[here + 1]
            stays = np.ones(len(symbol), bool)
            stays[here + 1] = False
            new = np.zeros(len(symbol), bool)
            new[here] = True
            symbol, rank, last, new = symbol[stays], rank[stays], last[stays], new[stays]
            at = np.flatnonzero(new)
            before = at[at > 0] - 1
            rank[at] = _NONE
            look = np.unique(np.concatenate([at, before]))
            look = look[~last[look]]
            rank[look] = self.ranks(symbol[look], symbol[look + 1])
        if not done_ids:
            return np.zeros(0, np.int32), count
        # words finish in any order; put their ids back in the order of the words
        ids, order = np.concatenate(done_ids), np.concatenate(done_who)
        size = count[order]
        target = np.cumsum(count) - count
        out = np.empty(len(ids), np.int32)
        out[np.arange(len(ids)) + np.repeat(target[order] - (np.cumsum(size) - size), size)] = ids
        return out, count


@functools.lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


class Remembered:
    """Results of pre-tokens seen by this worker: counts, or packed ids."""

    def __init__(self, model: Bpe, packed: bool):
        self.model, self.packed, self.known = model, packed, {}

    def learn(self, documents: Iterable[list[str | int]]) -> dict:
        """A table that knows every piece of these documents."""
        new: set = set()
        for pieces in documents:
            new.update(pieces)
        if len(self.known) > REMEMBERED:
            self.known = {}
        new.difference_update(self.known)
        special = [x for x in new if isinstance(x, int)]
        words = [x for x in new if not isinstance(x, int)]
        if self.packed:
            self.known.update((x, np.uint32(x).tobytes()) for x in special)
        else:
            self.known.update((x, 1) for x in special)
        for i in range(0, len(words), 200_000):
            some = words[i : i + 200_000]
            ids, count = self.model.encode(some)
            if self.packed:
                raw, stop = ids.astype("<u4").tobytes(), (4 * np.cumsum(count)).tolist()
                self.known.update(zip(some, (raw[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)), strict=True))
            else:
                self.known.update(zip(some, count.tolist(), strict=True))
        return self.known


@functools.lru_cache(maxsize=8)
def remembered(path: str, packed: bool) -> Remembered:
    return Remembered(bpe(path), packed)


def batches_of(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``limit`` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for a, b in K.slices(np.append(0, np.cumsum(size)), limit):
        yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit of the column text.

    tokenizer: path of a JSON file of the tokenizers library, on every node.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = remembered(tokenizer, False)
        for batch in (part for whole in batches for part in batches_of(whole)):
            documents = [memory.model.pieces(x) if x else [] for x in batch.column("text").to_pylist()]
            known = memory.learn(documents)
            n_tokens = np.array([sum(map(known.__getitem__, x)) for x in documents], np.int64)
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            columns = {"n_bytes": n_bytes, "n_tokens": pa.array(n_tokens), "over_limit": pa.array(n_tokens > limit)}
            out = with_columns(pa.Table.from_batches([batch]).drop_columns(["text"]), columns)
            yield from out.to_batches()

    return docs.mapInArrow(count, T.StructType([f for f in result_schema(docs, RESULT) if f.name != "text"]))
