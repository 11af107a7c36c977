"""Benchmark passages in documents, found by templates.

Texts are canonicalised: words lose case and outer punctuation, and numbers,
names and units become typed placeholders.  Windows of five canonical words
are hashed and joined with those of the benchmark.  Joined windows line up on
diagonals (place in the document minus place in the item); a document contains
an item if one diagonal covers enough of it, and if the slots are consistent:
each value of an item stands for one value of the document throughout, and the
other way round, or nearly all words on a diagonal agree as they are.  So questions with
other numbers or names are found as well as verbatim ones, and chance agreement
of single windows is not.  A window without a literal word counts by its
values, as all such windows would be equal else.

Values may have other numbers of words (Albany, New York; 45, twenty five;
120 km, 120km).  What the words do not find is therefore sought in a second
form, in which a run of names, or of numbers with their units, is one
placeholder whose value is the whole run, and capitals that open a sentence
count as names.  There the windows of neighbouring diagonals add up in order.
Which words are names is told by capitals; what neither form finds is sought in
a third one, in which names are words like others, whatever their case.

The benchmark is a stated query set.  Its windows are counted; blocks of at
most ``BLOCK`` windows are sent to all tasks one after another, and documents
are read where they are, without a shuffle.

Defined results: null texts match nothing; an item of fewer than five canonical
words has no window: it is matched only as it stands, word for word, and not at
all if it is a single word; items and documents
with a null id count like others; a repeated item or document gives its own
rows; of several places of an item in a document the best is told, of equally
good ones the first.  Very long texts are searched whole, hits of at most
``HITS`` windows at a time unless one document has more.  An empty table gives
no rows.  Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.token_counts import batches_of
from tessera.llm.windows import NO_ID

#: Canonical words of a window.
WINDOW = 5
#: An item is matched if so many words, or this share and at least ``LEAST`` words, lie on one diagonal.
ENOUGH, SHARE, LEAST = 20, 0.6, 8
#: Benchmark windows sent to tasks at once.
BLOCK = 2_000_000
#: Pairs of equal windows held at once.
HITS = 4_000_000
#: Share of words on one diagonal that agree as they are at which slots need not be consistent.
AS_IT_IS = 0.9

# Units, and numbers that are written out.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres kilometer kilometers inch inches foot feet yard yards mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons cup cups ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent usd eur gbp dollar dollars euro euros cent cents "
    "km/h mph m/s w kw kwh v a hz khz mhz ghz kb mb gb tb degree degrees"
).split()
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half"
).split()

#: In the second form: how far apart diagonals may lie that add up, and the literal words that tell an item from chance.
DRIFT, LITERAL = 8, 5

WORD, NUMBER, NAME, UNIT = range(4)
_DIGIT = np.array([0x30 <= i <= 0x39 for i in range(256)])
_END = np.array([chr(i) in ".!?:;\"" for i in range(256)])


def _hash_words(words: list[str]) -> np.ndarray:
    column = pa.array(words, pa.string())
    data, offsets = K.text_buffer(column)
    return np.sort(K.word_hashes(data, offsets[:-1], offsets[1:]))


_UNIT_HASHES, _NUMBER_HASHES = _hash_words(UNITS), _hash_words(NUMBER_WORDS)


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


class Canonical(NamedTuple):
    """Canonical words: hash as written, code in the template, kind; first of each text; words that open a sentence, and with a capital; word number."""

    own: np.ndarray
    code: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    opens: np.ndarray
    capital: np.ndarray
    word: np.ndarray


# Fixed values: (lead byte, first and last following byte, lead byte of the small letter, what is added to the following byte) in UTF-8,
# of Latin-1, Greek and Cyrillic capitals.
CAPITALS = ((0xC3, 0x80, 0x96, 0xC3, 0x20), (0xC3, 0x98, 0x9E, 0xC3, 0x20), (0xCE, 0x91, 0x9F, 0xCE, 0x20), (0xCE, 0xA0, 0xAB, 0xCF, -0x20), (0xD0, 0x90, 0x9F, 0xD0, 0x20), (0xD0, 0xA0, 0xAF, 0xD1, -0x20))


def lowered(data: np.ndarray) -> np.ndarray:
    """Small letters for ASCII, Latin-1, Greek and Cyrillic capitals; no byte moves."""
    out = K.lower_ascii(data)
    leads = np.flatnonzero((data[:-1] == 0xC3) | (data[:-1] == 0xCE) | (data[:-1] == 0xD0))
    for lead, low, high, small, add in CAPITALS if len(leads) else ():
        at = leads[(data[leads] == lead) & (data[leads + 1] >= low) & (data[leads + 1] <= high)]
        out[at], out[at + 1] = small, data[at + 1] + np.uint8(add % 256)
    return out


def canonical(data: np.ndarray, offsets: np.ndarray) -> Canonical:
    lower = lowered(data)
    starts, ends, _ = K.segment(data, offsets)
    last_raw = data[ends - 1] if len(ends) else data
    # trim punctuation: the next place that has none, and the last one
    inner = ~K.PUNCTUATION[data] | (data == 0x25)
    at = np.where(inner, np.arange(len(data)), len(data))
    following = np.minimum.accumulate(at[::-1])[::-1] if len(at) else at
    before = np.maximum.accumulate(np.where(inner, np.arange(len(data)), -1)) if len(at) else at
    low, high = following[starts] if len(starts) else starts, before[ends - 1] + 1 if len(ends) else ends
    real = low < np.minimum(high, ends)
    after_end = np.append(True, _END[last_raw[:-1]]) if len(ends) else np.zeros(0, bool)
    new_line = np.append(True, (np.cumsum(data == 0x0A)[starts[1:]] - np.cumsum(data == 0x0A)[starts[:-1]]) > 0) if len(starts) else np.zeros(0, bool)
    low, high, after_end, new_line = low[real], high[real], after_end[real], new_line[real]
    first = np.searchsorted(low, offsets)
    own = K.word_hashes(lower, low, high)
    opening = np.zeros(len(low), bool)
    opening[first[:-1][np.diff(first) > 0]] = True
    digits = np.append(0, np.cumsum(_DIGIT[data]))
    kind = np.zeros(len(low), np.int8)
    head = data[low]
    follower = data[np.minimum(low + 1, len(data) - 1)] if len(low) else head
    capital = ((head >= 0x41) & (head <= 0x5A)) | ((head == 0xC3) & (follower >= 0x80) & (follower <= 0x9E))
    opens = opening | after_end | new_line
    kind[capital & ~opens] = NAME
    kind[_within(own, _NUMBER_HASHES) | (digits[high] > digits[low])] = NUMBER
    unit = _within(own, _UNIT_HASHES)
    unit[1:] &= (kind[:-1] == NUMBER) & ~opening[1:]
    unit[:1] = False
    kind[unit] = UNIT
    code = np.where(kind == WORD, own, K.mix(kind.astype(np.uint64)))
    return Canonical(own, code, kind, first, opens, capital, np.arange(len(own)))


def collapsed(text: Canonical) -> Canonical:
    """The second form: runs of names, and of numbers with units, as one; opening capitals as names."""
    kind = np.where((text.kind == WORD) & text.opens & text.capital, NAME, np.where(text.kind == UNIT, NUMBER, text.kind)).astype(np.int8)
    head = np.ones(len(kind), bool)
    head[1:] = (kind[1:] == WORD) | (kind[1:] != kind[:-1]) | text.opens[1:]
    start = np.flatnonzero(head)
    own = K.range_hashes(text.own, start, np.append(start[1:], len(kind))) if len(start) else text.own
    kind = kind[start]
    code = np.where(kind == WORD, own, K.mix(kind.astype(np.uint64)))
    return Canonical(own, code, kind, np.searchsorted(start, text.first), text.opens[start], text.capital[start], start)


def caseless(text: Canonical) -> Canonical:
    """The third form: names are words."""
    named = text.kind == NAME
    return text._replace(code=np.where(named, text.own, text.code), kind=np.where(named, WORD, text.kind).astype(np.int8))


def windows(text: Canonical) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that lie in one text, and the word where each starts."""
    hashes = K.gram_hashes(text.code, WINDOW)
    literal = np.append(0, np.cumsum(text.kind == WORD))
    bare = literal[WINDOW:] == literal[: len(hashes)] if len(hashes) else np.zeros(0, bool)
    if bare.any():
        hashes = np.where(bare, K.mix(K.gram_hashes(text.own, WINDOW) ^ np.uint64(0x3C6EF372FE94F82B)), hashes)
    doc = np.repeat(np.arange(len(text.first) - 1), np.diff(text.first))
    whole = np.flatnonzero(np.arange(WINDOW, WINDOW + len(hashes)) <= text.first[doc[: len(hashes)] + 1])
    return hashes[whole], whole


class Index(NamedTuple):
    """Windows of a block of items, sorted by hash: item and place of each; the items' words."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    own: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    seen: np.ndarray
    word: np.ndarray
    size: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def index_items(ids: list[int], texts: list[str]) -> list[Index]:
    """The items in the three forms."""
    data, offsets = K.text_buffer(pa.array(texts, pa.string()))
    text = canonical(data, offsets)
    size = np.diff(text.first)
    forms = [_index(ids, form, size) for form in (text, collapsed(text), caseless(text))]
    return [forms[0]._replace(short=_short_items(data, offsets, size)), *forms[1:]]


def _short_items(data: np.ndarray, offsets: np.ndarray, size: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By number of words as written: hashes of the items that have no window, sorted, and which they are."""
    starts, ends, first = K.segment(data, offsets)
    words, n = K.word_hashes(data, starts, ends), np.diff(first)
    out = {}
    for k in np.unique(n[(size < WINDOW) & (size > 0) & (n > 1)]).tolist():
        items = np.flatnonzero((size < WINDOW) & (size > 0) & (n == k))
        hashes = K.gram_hashes(words, k)[first[items]]
        order = np.argsort(hashes, kind="stable")
        out[k] = (hashes[order], items[order])
    return out


def _short_matches(data: np.ndarray, offsets: np.ndarray, index: Index) -> list[tuple]:
    """Places where items without a window stand as they are, the first of each document and item."""
    found: dict[tuple[int, int], tuple] = {}
    starts, ends, first = K.segment(data, offsets) if index.short else (offsets[:0], offsets[:0], offsets)
    words = K.word_hashes(data, starts, ends)
    said = np.append(0, np.cumsum(~K.PUNCTUATION[data] | (data == 0x25)))
    real = np.append(0, np.cumsum(said[ends] > said[starts]))  # canonical words before each word
    for k, (hashes, items) in index.short.items():
        grams = K.gram_hashes(words, k)
        low, high = np.searchsorted(hashes, grams), np.searchsorted(hashes, grams, side="right")
        where = np.flatnonzero(high > low)
        doc = np.searchsorted(first, where, side="right") - 1
        inside = where + k <= first[doc + 1]
        for w, d in zip(where[inside].tolist(), doc[inside].tolist(), strict=True):
            for i in items[low[w] : high[w]].tolist():
                n = int(index.size[i])
                found.setdefault((d, i), (d, i, n, n, int(real[w] - real[first[d]]), 0, 0))
    return list(found.values())


def _index(ids: list[int], text: Canonical, n_words: np.ndarray) -> Index:
    hashes, place = windows(text)
    order = np.argsort(hashes, kind="stable")
    hashes, place = hashes[order], place[order]
    item = np.searchsorted(text.first, place, side="right") - 1
    seen = np.zeros(1 << 20, bool)
    seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return Index(hashes, item, place - text.first[item], np.array(ids, np.int64), text.own, text.kind, text.first, seen, np.append(text.word, n_words.sum()), n_words, {})


def _consistent(pairs: list[tuple[int, int, int]]) -> bool:
    """Whether slots map one to one: (kind, item's value, document's value)."""
    there: dict = {}
    back: dict = {}
    return all(there.setdefault((k, a), b) == b and back.setdefault((k, b), a) == a for k, a, b in pairs)


def _in_order(place: np.ndarray, diagonal: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of the item, and their diagonals, that the diagonals from ``base`` on cover in the order of both texts."""
    near = (diagonal >= base) & (diagonal <= base + DRIFT)
    place, diagonal = place[near], diagonal[near]
    kept: dict[int, int] = {}
    lines, count = np.unique(diagonal, return_counts=True)
    for line in lines[np.argsort(-count, kind="stable")].tolist():
        mine = np.unique((place[diagonal == line][:, None] + np.arange(WINDOW)).ravel())
        have = np.array(sorted(kept), np.int64)
        there = have + np.array([kept[x] for x in have.tolist()], np.int64)
        at = np.searchsorted(have, mine)
        fits = np.ones(len(mine), bool)
        if len(have):
            fits = have[np.minimum(at, len(have) - 1)] != mine
            fits &= (at == 0) | (there[at - 1] < mine + line)
            fits &= (at == len(have)) | (there[np.minimum(at, len(have) - 1)] > mine + line)
        kept.update((x, line) for x in mine[fits].tolist())
    words = np.array(sorted(kept), np.int64)
    return words, np.array([kept[x] for x in words.tolist()], np.int64)


def matches(data: np.ndarray, offsets: np.ndarray, forms: list[Index]) -> list[tuple]:
    """(document, item, words of it that were found, words of the item, place, slots, changed slots)."""
    text = canonical(data, offsets)
    found: dict[tuple[int, int], tuple] = {}
    for form, index, neighbours in ((text, forms[0], False), (collapsed(text), forms[1], True), (caseless(text), forms[2], False)):
        for row in _matches(form, index, neighbours):
            found.setdefault(row[:2], row)
    return list(found.values()) + _short_matches(data, offsets, forms[0])


def _matches(text: Canonical, index: Index, neighbours: bool) -> list[tuple]:
    hashes, where = windows(text)
    maybe = index.seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
    hashes, where = hashes[maybe], where[maybe]
    low, high = np.searchsorted(index.hashes, hashes), np.searchsorted(index.hashes, hashes, side="right")
    doc = np.searchsorted(text.first, where, side="right") - 1
    upto = np.append(0, np.cumsum(high - low))
    out, start = [], 0
    while start < len(where):  # whole documents
        stop = max(int(np.searchsorted(upto, upto[start] + HITS, side="right")) - 1, start + 1)
        stop = len(where) if stop >= len(where) else max(int(np.searchsorted(doc, doc[stop])), int(np.searchsorted(doc, doc[start], side="right")))
        out += _aligned(text, index, neighbours, where[start:stop], low[start:stop], high[start:stop])
        start = stop
    return out


def _aligned(text: Canonical, index: Index, neighbours: bool, where: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple]:
    """Matches of windows that start at the words ``where`` and have these ranges of the index."""
    many = high - low
    hit = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    where = np.repeat(where, many)
    if not len(hit):
        return []
    doc = np.searchsorted(text.first, where, side="right") - 1
    item, place = index.item[hit], index.place[hit]
    diagonal = where - text.first[doc] - place
    order = np.lexsort((place, diagonal, item, doc))
    doc, item, diagonal, place = doc[order], item[order], diagonal[order], place[order]
    start = K.group_starts(doc, item, diagonal)
    stop = np.append(start[1:], len(doc))
    # each window adds the words that the one before it on the diagonal did not cover
    new = np.full(len(doc), WINDOW)
    new[1:] = np.minimum(WINDOW, np.maximum(place[1:] - place[:-1], 0))
    new[start] = WINDOW
    covered = np.add.reduceat(new, start)
    size = np.diff(index.first)[item[start]]
    enough = (covered >= ENOUGH) | ((covered >= SHARE * size) & (covered >= np.minimum(LEAST, size)))
    best: dict = {}

    def consider(d: int, i: int, words: np.ndarray, diagonals: np.ndarray) -> None:
        mine, its = text.first[d] + diagonals + words, index.first[i] + words
        slots = np.flatnonzero(index.kind[its] != WORD)
        pairs = list(zip(index.kind[its][slots].tolist(), index.own[its][slots].tolist(), text.own[mine][slots].tolist(), strict=True))
        as_it_is = np.count_nonzero(index.own[its] == text.own[mine])
        if neighbours and len(words) - len(slots) < LITERAL or (neighbours or as_it_is < AS_IT_IS * len(words)) and not _consistent(pairs):
            return
        n_words = int((index.word[its + 1] - index.word[its]).sum())
        start_word = int(text.word[mine[0]] - text.word[text.first[d]])
        row = (d, i, n_words, int(index.size[i]), start_word, len(pairs), sum(a != b for _, a, b in pairs))
        key = (d, i)
        if key not in best or (row[2], -row[6], -row[4]) > (best[key][2], -best[key][6], -best[key][4]):
            best[key] = row

    for g in np.flatnonzero(enough).tolist():
        words = np.unique((place[start[g] : stop[g], None] + np.arange(WINDOW)[None, :]).ravel())
        consider(int(doc[start[g]]), int(item[start[g]]), words, np.full(len(words), diagonal[start[g]]))
    if neighbours:
        first = K.group_starts(doc, item)
        last = np.append(first[1:], len(doc))
        total = np.add.reduceat(new, first)
        size = np.diff(index.first)[item[first]]
        maybe = (diagonal[first] != diagonal[last - 1]) & ((total >= ENOUGH) | ((total >= SHARE * size) & (total >= np.minimum(LEAST, size))))
        for g in np.flatnonzero(maybe).tolist():
            d, i, n = int(doc[first[g]]), int(item[first[g]]), int(size[g])
            if (d, i) in best:
                continue
            its, lines = place[first[g] : last[g]], diagonal[first[g] : last[g]]
            for base in np.unique(lines).tolist():
                words, diagonals = _in_order(its, lines, base)
                if len(words) >= ENOUGH or len(words) >= SHARE * n and len(words) >= min(LEAST, n):
                    consider(d, i, words, diagonals)
    return list(best.values())


RESULT = "doc_id long, item_id long, matched_words long, item_words long, start_word long, n_slots long, changed_slots long, contaminated boolean"


def _against(docs: DataFrame, index: list[Index]) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in batches_of(whole)):
            found = matches(*K.text_buffer(batch.column("text")), index)
            ids = batch.column("doc_id").cast(pa.int64())
            column = lambda k: pa.array([x[k] for x in found], pa.int64())
            items = index[0].ids[[x[1] for x in found]] if found else np.zeros(0, np.int64)
            yield pa.record_batch({
                "doc_id": ids.take(column(0)),
                "item_id": pa.array(items, pa.int64(), mask=items == NO_ID),
                "matched_words": column(2), "item_words": column(3), "start_word": column(4), "n_slots": column(5), "changed_slots": column(6),
                "contaminated": pa.array([True] * len(found), pa.bool_()),
            })

    return docs.select("doc_id", "text").mapInArrow(search, RESULT)


def _without(docs: DataFrame, index: list[Index]) -> DataFrame:
    """The rows of docs that contain none of the items."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in batches_of(whole)):
            clean = np.ones(batch.num_rows, bool)
            clean[[x[0] for x in matches(*K.text_buffer(batch.column("text")), index)]] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)


def _indexes(benchmark: DataFrame, block: int) -> Iterator[list[Index]]:
    """Indexes of about ``block`` windows each."""
    items = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("long"), F.lit(int(NO_ID))).alias("item_id"), "text")
    words = items.select(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    blocks = -(-words // block) or 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about ``block`` windows
        yield index_items([r.item_id for r in rows], [r.text for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document and item that it contains, with the best place.

    doc_id, item_id, matched_words (of item_words), start_word (in canonical
    words), n_slots, changed_slots (above 0: re-parameterised), contaminated.
    """
    return reduce(DataFrame.unionByName, [_against(docs, index) for index in _indexes(benchmark, block)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without the rows that contain an item; told row by row, whatever their ids."""
    for index in _indexes(benchmark, block):
        docs = _without(docs, index)
    return docs
