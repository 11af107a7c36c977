"""Token counts and packing against the tokenizer library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm.packing import pack_documents, plan_packing
from tessera.llm.queries import tokenizer_path
from tessera.llm.token_counts import bpe, count_tokens

TEXTS = [
    None, "", " \n ", "a" * 37, "Hello <|endoftext|> world's don't I'LL ΣΑΣ İstanbul ½ x²", "\x1c\x1d a\u0085b 日本語 😀👍🏽 é ﬁ",
    "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "a_#b __ 12345 ٣٤", "᠎ x​ y", "baaaaaaaaaaaab abababababab", "Größe naïve cœur",
]


def _docs(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "Beta", "gamma's", "12", "é", "x" * 30]) for _ in range(n)) for n in (3, 50, 50, 2500, 9000)]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def test_every_character():
    model = bpe(tokenizer_path())
    texts = [f"a{chr(i)}b{chr(i)}{chr(i)}" for i in range(1, 0x3100)]
    for text, expected in zip(texts, model.library.encode_batch(texts, add_special_tokens=False), strict=True):
        words = model.pieces(text)
        ids, _ = model.encode(words) if words else (np.zeros(0, np.int32), None)
        assert ids.tolist() == expected.ids, repr(text)


def test_counts(spark):
    texts, docs = _docs(spark)
    library = bpe(tokenizer_path()).library
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, tokenizer_path()).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 2048)
    assert count_tokens(docs.where("false").selectExpr("*", "1 AS n_tokens"), tokenizer_path()).count() == 0


def test_thousands_of_special_strings(spark):
    text = "joined dump<|endoftext|> é <|startoftext|><|endoftext|>" * 2000
    expected = len(bpe(tokenizer_path()).library.encode(text, add_special_tokens=False).ids)
    assert [r.n_tokens for r in count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_path()).collect()] == [expected]
    assert sum(r.length for r in pack_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_path()).collect()) == expected + 1


def test_packing(spark):
    texts, docs = _docs(spark)
    library = bpe(tokenizer_path()).library
    rows = pack_documents(docs, tokenizer_path()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and [p.start for p in pieces] == list(range(0, len(ids), 4096))
        for p in pieces:
            own = ids[p.start : p.start + 4096]
            assert p.length == len(own) and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    for pieces in by_sequence.values():
        end = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == end
            end += p.length
        assert end <= 4096
    assert pack_documents(docs.where("false"), tokenizer_path()).count() == 0


def _optimum(lengths, capacity):
    """The least number of sequences, by trying."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_sound_and_near_the_optimum(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 11))]
    counts = {x: lengths.count(x) for x in lengths}
    ranges, n = plan_packing(counts, 20)
    used = defaultdict(int)
    for length, _, many, sequence, _ in ranges:
        for s in range(sequence, sequence + many):
            used[s] += length
    assert len(used) == n and max(used.values()) <= 20 and sum(used.values()) == sum(lengths)
    assert n <= _optimum(lengths, 20) + (1 if len(lengths) > 6 else 0)
