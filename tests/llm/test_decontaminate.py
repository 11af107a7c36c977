"""Benchmark passages in documents."""

import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contaminated, decontaminate, lowered
from tessera.llm.queries import op5_decontaminate

ITEM = "A train leaves Boston at 3 pm and travels 120 km to reach Albany while Maria waits near Albany for 45 minutes before dinner."


def _found(spark, texts, items=(ITEM,), **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return contaminated(docs, benchmark, **options).collect()


def test_reparameterised(spark):
    other = ITEM.replace("Boston", "Madrid").replace("Albany", "Toledo").replace("120 km", "75 mi").replace("45", "20").upper().replace(" A TRAIN", " a train")
    same_case = ITEM.replace("Boston", "Madrid").replace("Albany", "Toledo").replace("120 km", "75 mi").replace("45", "20")
    mixed = same_case.replace("to reach Toledo", "to reach Sevilla")  # Albany would stand for two places
    rows = _found(spark, [f"Some words before. {same_case} And after.", f"So: {mixed}", "nothing here of note", None, "", ITEM, other])
    by_doc = {r.doc_id: r for r in rows}
    assert {0, 5} <= set(by_doc) and not {1, 2, 3, 4} & set(by_doc)
    assert by_doc[0].changed_slots > 0 and by_doc[5].changed_slots == 0 and by_doc[5].matched_words == by_doc[5].item_words
    assert all(r.contaminated for r in rows)


def test_values_of_other_lengths(spark):
    items = (ITEM, "Tom has 5 apples. Tom buys 3 pears. Tom eats 2 plums. How many has Tom?", "Bob is 7. Amy is 9. Joe is 4.")
    texts = [
        ITEM.replace("Albany", "New York"), ITEM.replace("45", "twenty five"), ITEM.replace("120 km", "120km"), ITEM.replace("Boston", "old santa fe"),
        items[1].replace("Tom", "Anna"), items[1].replace("Tom", "Mary Ann").replace("5", "twenty one"),
        "Anna has 5 apples. Ben buys 3 pears. Carl eats 2 plums. How many has Dora?", ITEM.replace("Albany", "New York", 1), "Ann is 1. Eve is 2. Max is 3. Leo is 8.",
    ]
    rows = _found(spark, texts, items)
    assert {(r.doc_id, r.item_id) for r in rows} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1)}
    by_doc = {r.doc_id: r for r in rows}
    assert by_doc[0].item_words == 24 and by_doc[0].matched_words == 24 and by_doc[0].changed_slots == 2


def test_short_items_blocks_and_copies(spark):
    items = ["one two", None, "", "alpha beta gamma delta epsilon", ITEM, ITEM]
    texts = ["alpha beta gamma delta epsilon", "zeta alpha, beta gamma; delta epsilon eta", ITEM, ITEM]
    expected = {(0, 3), (1, 3), (2, 4), (2, 5), (3, 4), (3, 5)}
    for block in (2_000_000, 10):
        assert {(r.doc_id, r.item_id) for r in _found(spark, texts, items, block=block)} == expected
    assert _found(spark, texts, []) == [] and _found(spark, []) == []


def test_short_items_stand_as_they_are(spark):
    items = ["Tom has 12 apples", "Tom has", "apples", "Is it - so ?", "Tom has 12 apples", "!"]
    texts = ["He says: Tom has 12 apples now. Tom has 12 apples", "Tom has 13 apples", "tom has 12 apples", "Tom has 12", "x Is it - so ? y", "apples !", "Tom", "has 12 apples"]
    rows = _found(spark, texts, items)
    assert {(r.doc_id, r.item_id) for r in rows} == {(0, 0), (0, 1), (0, 4), (1, 1), (3, 1), (4, 3)}
    place = {(r.doc_id, r.item_id): (r.start_word, r.matched_words, r.item_words) for r in rows}
    assert place[0, 0] == (2, 4, 4) and place[4, 3] == (1, 3, 3)


def test_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    plain = lambda x: " ".join(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    docs = {r.doc_id: plain(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    verbatim = {(d, i) for d, x in docs.items() for i, y in items.items() if f" {y} " in f" {x} "}
    got = {(r.doc_id, r.item_id) for r in op5_decontaminate(spark, sf).collect()}
    assert verbatim and verbatim <= got
    for d, i in got - verbatim:  # parts of an item: they must at least share a long run of words
        words = items[i].lower().split()
        assert any(" ".join(words[k : k + 5]) in docs[d].lower() for k in range(len(words) - 4))


def test_any_case(spark):
    sf = "/root/testdata/sf0.01"
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").collect()]
    texts = [f"Seen before: {f(x)} So much for that." for f in (str.upper, str.lower, str.title, str.swapcase) for x in items]
    found = {(r.doc_id, r.item_id) for r in _found(spark, texts, items)}
    assert {(d, d % len(items)) for d in range(len(texts))} <= found


def test_small_letters():
    text = "AZ ÀÖØÞ×ß ΑΟΠΫ АПРЯ ÿ 日本 é"
    assert lowered(np.frombuffer(text.encode(), np.uint8)).tobytes().decode() == text.lower()


def test_one_slip_among_many_words(spark):
    slip = ITEM.replace("near Albany", "near Albanny")
    assert [r.matched_words for r in _found(spark, [slip])] != []


def test_bare_windows_count_by_value(spark):
    numbers = " ".join(str(i * 7919 % 10007) for i in range(600))
    others = " ".join(str(i * 104729 % 10007) for i in range(6000))
    rows = _found(spark, [others, f"Here: {numbers} there.", "Start " + "7 " * 5000], [numbers])
    assert [(r.doc_id, r.matched_words) for r in rows] == [(1, 600)]


def test_null_ids_ties_and_long_texts(spark):
    long = " ".join("v" + "ab"[i % 2] * (i % 9) + "cd"[i % 5 % 2] for i in range(200_000))
    docs = spark.createDataFrame([(None, f"{long}. {ITEM} {ITEM}", "a"), (2, ITEM, "b"), (2, "clean", "c"), (None, None, "d")], "doc_id int, text string, contaminated string")
    benchmark = spark.createDataFrame([(None, ITEM), (7, None)], "item_id long, text string")
    rows = sorted(contaminated(docs, benchmark).collect(), key=lambda r: r.start_word)
    assert [(r.doc_id, r.item_id, r.start_word) for r in rows] == [(2, None, 0), (None, None, 200_000)]
    kept = decontaminate(docs, benchmark)
    assert kept.schema == docs.schema and sorted(r.contaminated for r in kept.collect()) == ["c", "d"]
    for block in (2_000_000, 10):
        assert decontaminate(docs, benchmark.unionByName(benchmark.withColumn("text", F.lit("some other text of eight words in all"))), block).count() == 2


def test_filter_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (2, "clean", "b"), (None, "clean too", None)], "doc_id long, text string, item_id string")
    benchmark = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    kept = decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["clean", "clean too"]
