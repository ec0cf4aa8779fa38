import re

import numpy as np
from helpers import compare

from lorespan.llm import catalogue, leakage
from lorespan.llm.fm_index import FMIndex, suffix_array


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    for k in (2, 40):
        text = rng.integers(0, k, 400)
        full = np.append(text + 1, 0)
        assert suffix_array(full).tolist() == sorted(range(401), key=lambda i: full[i:].tolist())
        index = FMIndex(text)
        phrases = rng.integers(1, k + 3, (100, 3))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(398) if (text[i : i + 3] == p).all()]


DOCS = "doc_id long, text string, item string, first_word int"
ITEMS = "item_id long, suite string, text string"
TWELVE = "one two three four five six seven eight nine ten eleven twelve"


def spans(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, "s", t) for i, t in items], ITEMS)
    return sorted((r.doc_id, r.item_id, r.first_word, r.last_word) for r in leakage.leaked_passages(d, q).collect())


def test_passages(spark):
    items = [(1, TWELVE + " thirteen"), (2, "a b c d e f g h"), (3, "a b c d e f g"), (4, None), (5, ""), (6, TWELVE.upper() + "!")]
    docs = [(1, "zero " + TWELVE.replace(" ", "-") + ", thirteen end"), (2, "x a b c d e f g h y a b c d e f g h"), (3, TWELVE[4:]), (4, None), (5, ""), (6, TWELVE), (6, TWELVE), (None, TWELVE)]
    assert spans(spark, docs, items) == [(1, 1, 1, 13), (1, 6, 1, 12), (2, 2, 1, 8), (2, 2, 10, 17), (6, 1, 0, 11), (6, 6, 0, 11)]


def test_parts_and_shards_change_nothing(spark, monkeypatch):
    items = [(i, f"{TWELVE} w{i} v{i}") for i in range(7)]
    docs = [(i, f"x {TWELVE} w{i % 5} v{i % 5} y") for i in range(40)]
    once = spans(spark, docs, items)
    monkeypatch.setattr(leakage, "ITEMS_PER_PART", 2)
    monkeypatch.setattr(leakage, "SHARD_WORDS", 20)
    assert spans(spark, docs, items) == once and len(once) == 40 * 7


def test_many_items_read_the_corpus_once(spark):
    """60 000 items are searched in three parts in the same index; one scan, one pass of Python."""
    items = spark.range(60_000).selectExpr("id as item_id", "concat(id % 300, ' two three four five six seven eight nine ten eleven twelve') as text")
    docs = spark.range(20).selectExpr("id as doc_id", "concat('x ', id * 10, ' two three four five six seven eight nine ten eleven twelve y') as text")
    found = leakage.leaked_passages(docs, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Range") == 1
    assert found.count() == 20 * 200


def test_empty_tables(spark):
    assert spans(spark, [], [(1, TWELVE)]) == [] and spans(spark, [(1, TWELVE)], []) == []


def test_word_is_letters_and_digits():
    import regex

    text = "".join(map(chr, [c for c in range(0x3000) if chr(c).isprintable()]))
    assert re.findall(leakage.WORD, text) == regex.findall(r"[\p{L}\p{N}]+", text)


def test_found_equals_sql(spark, data):
    compare(spark, data, catalogue.QUERIES["p7_found"], catalogue.SQL["p7_found"])


def test_spans_equal_sql(spark, data):
    compare(spark, data, catalogue.QUERIES["p7_spans"], catalogue.SQL["p7_spans"])
