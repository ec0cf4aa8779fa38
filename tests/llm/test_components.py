import random

import pytest
from helpers import compare

from lorespan.llm import catalogue
from lorespan.llm.components import connected_groups, duplicate_classes


def brute(links):
    of = {}

    def root(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            of[max(root(a), root(b))] = min(root(a), root(b))
    names = {}
    for x in of:
        names.setdefault(root(x), []).append(x)
    return {x: min(all_) for all_ in names.values() for x in all_}


def groups(spark, links):
    rows = connected_groups(spark.createDataFrame(links, "a string, b string")).collect()
    assert len({r.member for r in rows}) == len(rows)
    return {r.member: r.group_name for r in rows}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "dirty"])
def test_equals_union_find(spark, kind):
    rng = random.Random(3)
    links = {
        "chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)],
        "star": [("hub", f"n{i}") for i in range(200)],
        "random": [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(100)],
        "dirty": [("a", "a"), (None, "b"), ("c", None), ("d", "e"), ("e", "d"), ("d", "e")],
    }[kind]
    assert groups(spark, links) == brute(links)


def test_lists(spark):
    lists = [(1, [" A ", "b", None, "B", ""]), (2, ["b", "c"]), (3, None), (4, []), (5, ["z"]), (6, ["x\t", "X"]), (1, [" A ", "b", None, "B", ""])]
    df = spark.createDataFrame(lists, "member long, slugs array<string>")
    assert sorted(map(tuple, duplicate_classes(df).collect())) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert duplicate_classes(df.limit(0)).collect() == []


def test_found_equals_sql(spark, data):
    compare(spark, data, catalogue.QUERIES["p5_found"], catalogue.SQL["p5_found"])
