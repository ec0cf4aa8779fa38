import random

import pytest
import regex
from helpers import compare

from lorespan.llm import catalogue
from lorespan.llm import near_duplicates as N


def jaccard(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def family(rng, count, size=20, words=400):
    sets = []
    for _ in range(count // 5):
        base = [f"w{rng.randrange(words)}" for _ in range(size)]
        for _ in range(5):
            own = {rng.choice([w, w, w, w, w, w, w, f"w{rng.randrange(words)}"]) for w in base}
            sets.append(sorted(own))
    return sets


def brute(sets, threshold):
    return {(i, j): jaccard(sets[i], sets[j]) for j in range(len(sets)) for i in range(j) if jaccard(sets[i], sets[j]) >= threshold - 1e-12}


def searched(spark, sets, threshold):
    ranked = N.ranked_sets(spark.createDataFrame(list(enumerate(sets)), "id long, words array<string>"))
    rows = N.similar_sets(ranked, threshold).collect()
    got = {(r.a, r.b): r.similarity for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("words, threshold", [(30, 0.7), (400, 0.7), (60, 0.35), (60, 0.9)])
def test_search_equals_brute_force(spark, words, threshold):
    sets = [list(x) for x in dict.fromkeys(map(tuple, family(random.Random(words), 150, words=words)))]
    want = brute(sets, threshold)
    assert searched(spark, sets, threshold) == pytest.approx(want) and want


@pytest.mark.parametrize("threshold", [0.1, 0.34, 0.5, 0.75])
@pytest.mark.parametrize("hot", [3, 4000])
def test_small_sets_and_hot_words(spark, monkeypatch, threshold, hot):
    """Sets of one to six of eight words: every word is hot, and pairs may share as few words as a key has."""
    rng = random.Random(3)
    sets = [sorted(s) for s in {frozenset(rng.sample("abcdefgh", rng.randint(1, 6))) for _ in range(70)}]
    monkeypatch.setattr(N, "HOT_RECORDS", hot)
    monkeypatch.setattr(N, "STEP", 50)
    monkeypatch.setattr(N, "ROWS", 20)
    assert searched(spark, sets, threshold) == pytest.approx(brute(sets, threshold))


def test_a_word_of_all_sets(spark, monkeypatch):
    """Templates that share most of their words: the blocks of these are split by further words."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(14)]
    sets = [sorted({*rng.sample(common, 12), *rng.sample([f"r{i}" for i in range(40)], 3)}) for _ in range(150)]
    sets = [list(x) for x in dict.fromkeys(map(tuple, sets))]
    monkeypatch.setattr(N, "HOT_RECORDS", 25)
    want = brute(sets, 0.7)
    assert searched(spark, sets, 0.7) == pytest.approx(want) and want


SCHEMA = "summary_id long, title string, description string, tags array<string>, class int, words string"


def test_records(spark, monkeypatch):
    rng = random.Random(5)
    sets = family(rng, 120, size=14, words=60)
    rows = [(i, " ".join(s[:3]).upper(), ", ".join(s[3:]), None, 1, "x") for i, s in enumerate(sets)]
    rows += [(500, None, None, None, 1, "x"), (501, "", "", [], 1, "x"), (502, "one two", "three", ["four", None], 1, "x"), (None, "a", "b", [], 1, "x")]
    rows += [(600 + i, "copy of these ten words one two three four", "five", ["six"], 1, "x") for i in range(4)] + [rows[0]]
    ids = {r[0]: set(regex.findall(r"[\p{L}\p{N}]+", " ".join([r[1] or "", r[2] or "", *[t for t in r[3] or [] if t]]).lower())) for r in rows if r[0] is not None}
    ids = {k: v for k, v in ids.items() if len(v) >= 10}
    want = sorted((a, b) for a in ids for b in ids if a < b and jaccard(ids[a], ids[b]) >= 0.7)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, N.found_pairs(df).collect())) == want and (600, 603) in want
    monkeypatch.setattr(N, "HOT_RECORDS", 7)
    monkeypatch.setattr(N, "SHORT_LIST", 1)
    assert sorted(map(tuple, N.found_pairs(df).collect())) == want


def test_empty_table(spark):
    assert N.found_pairs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_found_equals_sql(spark, data):
    compare(spark, data, catalogue.QUERIES["p2_found"], catalogue.SQL["p2_found"])


def test_members_equal_sql(spark, data):
    compare(spark, data, catalogue.QUERIES["p2_members"], catalogue.SQL["p2_members"])
