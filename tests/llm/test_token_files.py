"""The range coder's round trips, and token files against the tokenizer library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.errors import CorruptIndex
from tessera.llm import piece_table, range_coder, token_files
from tessera.llm.queries import op12_token_files, tokenizer_path

SF = "/root/testdata/sf0.001"
PATH = tokenizer_path("byte_bpe_50k.json")


def _library(texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(PATH).encode_batch(list(texts), add_special_tokens=False)]


def _cases():
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 50_000, 40)
    return {
        "none": [], "one": [7], "same": [9] * 9000, "two": [1, 2] * 3000, "ascending": range(3000), "short last block": rng.integers(0, 50, 513), "uniform": rng.integers(0, 50_257, 20_000),
        "wide": rng.integers(0, 1 << 32, 3000, dtype=np.uint64), "frequent": np.minimum(rng.zipf(1.2, 60_000), 40_000), "phrases": np.concatenate([np.append(phrase, rng.integers(0, 50_000, 3)) for _ in range(400)]),
        "end marks": [0] * 700, "full blocks": rng.integers(0, 9, 4 * 512),
    }


@pytest.mark.parametrize("name", _cases())
def test_round_trip(name):
    ids = np.array(_cases()[name]).astype(np.uint32)
    coded = range_coder.encode_segment(ids)
    assert (range_coder.decode_segment(coded) == ids).all() and len(range_coder.decode_segment(coded)) == len(ids)


def test_blocks_are_small_where_ids_can_be_foreseen():
    cases = _cases()
    size = {name: len(range_coder.encode_segment(np.array(cases[name]).astype(np.uint32))) * 8 / len(cases[name]) for name in ("same", "two", "phrases", "uniform")}
    assert size["same"] < 1 and size["two"] < 1 and size["phrases"] < 6 and size["uniform"] < 20


def test_blocks_are_independent_and_checked(monkeypatch):
    ids = np.random.default_rng(4).integers(0, 300, 5000).astype(np.uint32)
    coded = bytearray(range_coder.encode_segment(ids))
    for at in (len(coded) - 3, len(coded) // 2, len(coded) // 3):
        broken = bytearray(coded)
        broken[at] ^= 4
        with pytest.raises(CorruptIndex):
            range_coder.decode_segment(bytes(broken))
    with pytest.raises(CorruptIndex):
        range_coder.decode_segment(bytes(coded[:-10]))
    # the same ids, coded with others beside them, make the same block
    first = range_coder.encode_segment(ids[:512])
    other = range_coder.encode_segment(np.concatenate([ids[:512], ids[::-1][:2000]]))
    body = first[range_coder._HEAD.size + 12 :]
    n_list = 2 * int(np.frombuffer(first, "<u4", 1, range_coder._HEAD.size)[0])
    assert body[:n_list] in other and body[n_list:] in other


def test_pieces_equal_the_librarys():
    rng = np.random.default_rng(11)
    alphabet = list("aB z19'.,-\n\t  'sé'tß\r") + ["<|endoftext|>", "'ll", "'re", "ÿ", "×", "ÑŽ", "中", "и", "ˇ", "\xa0", "\x1c", "²", "🙂", "é", " ", "\x85", "İ", "ı"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(4000)]
    memory = token_files._remembered(PATH)
    pieces = [memory.model.pieces(x) for x in texts]
    known = memory.learn(pieces)
    got = [np.frombuffer(b"".join(known[x] for x in p), "<u4").tolist() for p in pieces]
    assert got == _library(texts)


def test_the_table(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, at = [], 0
    for (i, _), ids in zip(docs, _library(t for _, t in docs), strict=True):
        ids = np.array([*ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in op12_token_files(spark, SF).collect()) == want


def _folder(tmp_path):
    return f"file://{tmp_path}/ids"


def test_odd_documents(spark, tmp_path):
    """Nulls, empty and very long texts, equal ids and rows, clashing columns; many files, documents over several segments."""
    long = "word after word, " * 40_000
    rows = [(5, "five"), (3, None), (4, ""), (None, "no id"), (1, long), (2, "two"), (2, "two again"), (-7, "below")] + [(9, "often")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("id"), F.lit("x").alias("ids"), F.lit(2).alias("hash"), F.lit(0).alias("n_tokens"), F.lit(0).alias("start")).repartition(5)
    token_files.write(token_files.encode(docs, PATH), _folder(tmp_path), per_file=200)
    got = token_files.read(spark, _folder(tmp_path)).orderBy("start").collect()
    assert sum(r.n_tokens for r in got[:-1]) == got[-1].start and [len(r.ids) for r in got] == [4 * r.n_tokens for r in got]
    assert [r.id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    texts = {bytes(np.array([*ids, 0], "<u4").tobytes()) for ids in _library(t or "" for _, t in rows)}
    assert {bytes(r.ids) for r in got} == texts and len(got) == len(rows)
    files = list((tmp_path / "ids").glob("*.ids"))
    assert len(files) > 3 and got[0].start == 0
    assert len(token_files.read(spark, _folder(tmp_path)).where("id = 9").select("start").distinct().collect()) == 300


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(token_files.encode(docs, PATH), _folder(tmp_path))
    back = token_files.read(spark, _folder(tmp_path))
    assert back.columns == ["id", "start", "n_tokens", "ids"] and back.count() == 0


def test_string_ids_and_files_not_listed(spark, tmp_path):
    docs = spark.createDataFrame([("b", "second"), ("a", "first")], "doc_id string, text string")
    token_files.write(token_files.encode(docs, PATH), _folder(tmp_path))
    (tmp_path / "ids" / "000000-of-a-lost-task.ids").write_bytes(b"half a file")
    assert [r.id for r in token_files.read(spark, _folder(tmp_path)).orderBy("start").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="no token files"):
        token_files.read(spark, f"file://{tmp_path}/nothing")


def _table(remembered=piece_table.REMEMBERED):
    return piece_table.PieceTable(token_files.ByteBpe(PATH), 0, remembered)


def _encoded(table, texts):
    ids, n = table.encode(pa.array(texts, pa.string()))
    assert n.sum() == len(ids)
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_a_table_of_pieces_gives_the_librarys_ids():
    rng = np.random.default_rng(12)
    plain = [*"aB z19'.,-\n\t 'stdr\r\x0b\x0c", "'ll", "'re", "'v", "ve", "s's", "  ", "\n\n", "é", "ſ", "ÿ", "\"'s", " 's", "''t", "'RE", "'m9", "'d "]
    odd = [*plain, "<|endoftext|>", "×", "÷", "中", "\xa0", "\x1c", "²", "🙂", "\x00", "İ"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for letters, n in ((plain, 5000), (odd, 2000)) for _ in range(n)]
    texts += ["", None, "'", "'s", " ", "  ", "\n", "'l", "'r", "a'", "a" * 16, "a" * 17, " " + "b" * 64, "c" * 65, "d" * 5000, "it's\n", "x" * 8 + "'ve", None, ""]
    want = [[*ids, 0] for ids in _library(t or "" for t in texts)]
    table = _table(3000)
    assert _encoded(table, texts) == want
    assert [x for i in range(0, len(texts), 500) for x in _encoded(table, texts[i : i + 500])] == want  # what is remembered is dropped meanwhile
    sliced = pa.array(texts, pa.string()).slice(100, 50)
    assert table.encode(sliced)[0].tolist() == [i for x in want[100:150] for i in x]


def test_a_table_grows_and_forgets_long_pieces():
    table = _table()
    words = [f"w{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{chr(97 + i // 6760)}" for i in range(20_000)]
    assert _encoded(table, words) == [[*x, 0] for x in _library(words)]
    assert table.words == 20_001 and len(table.key) >= 2 * table.words
    used = table.used
    assert _encoded(table, words[::-1]) == [[*x, 0] for x in _library(words[::-1])]
    _encoded(table, ["q" * 100_000])
    assert table.used == used and table.words == 20_001 and not table.long


def test_ids_are_ranks_of_merges():
    """Every token of the vocabulary is what its own merges make."""
    model = token_files.ByteBpe(PATH)
    tokens = [(i, bytes(model.bytes_of[c] for c in name).decode("utf-8", "surrogateescape")) for name, i in model.vocab.items() if name not in model.special]
    ids, count = model.encode([x for _, x in tokens])
    assert (count == 1).all() and ids.tolist() == [i for i, _ in tokens]


def test_a_file_has_no_small_segment(spark, tmp_path, monkeypatch):
    """Each segment costs as many steps as its blocks are long, so a file's ids are dealt evenly."""
    docs = spark.createDataFrame([(i, "some words " * 40) for i in range(60)], "doc_id long, text string").coalesce(1)
    rows = token_files.encode(docs, PATH).select("id", "n_tokens", "ids").orderBy("id").toArrow().to_batches()
    total = sum(n for b in rows for n in b.column("n_tokens").to_pylist())
    sizes, code = [], range_coder.encode_segment
    monkeypatch.setattr(range_coder, "encode_segment", lambda ids: (sizes.append(len(ids)), code(ids))[1])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    for segment, want in ((total, 1), (total * 5 // 6, 1), (total // 3 - 10, 3), (total // 7, 7)):
        sizes.clear()
        monkeypatch.setattr(token_files, "SEGMENT", segment)
        token_files._Writer(_folder(tmp_path), None).write(iter(rows))
        assert sum(sizes) == total and len(sizes) == want and min(sizes) > segment // 2
