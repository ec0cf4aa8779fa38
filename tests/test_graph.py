import math
import random

import pytest

from lorespan.operators import graph as G

KINDS = ["entity", "concept", "source", "query", "synthesis", "comparison", "other"]


def brute_related(nodes, edges, k):
    near = {n[0]: set() for n in nodes}
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    ways = {(a, b) for a, b, _ in edges}
    degree = {m: sum(m in way for way in ways) for m in near}  # outgoing and incoming ones, so that a mutual link counts two
    out = set()
    for i, p, t, s in nodes:
        scored = []
        for j, q, u, r in nodes:
            if i != j and p == q:
                links = ((i, j) in ways) + ((j, i) in ways)
                common = sum(1 / math.log(max(degree[m], 2)) for m in near[i] & near[j])
                scored.append((-round(3 * links + 4 * len(set(s) & set(r)) + 1.5 * common + G.AFFINITY.get(t, {}).get(u, 0.5), 6), j))
        out |= {(i, j, -score, n) for n, (score, j) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("hub", [1, 3, 64])
def test_related_takes_every_page_of_the_project(spark, hub):
    rng = random.Random(3)
    nodes = [(f"p{i:02}", "ab"[i % 2], rng.choice(KINDS), rng.sample(["s1", "s2", "s3", "s4"], rng.choice([0, 0, 1, 2]))) for i in range(60)]
    pairs = {(rng.randrange(60), rng.choice([0, 1, 2, 3, rng.randrange(60)])) for _ in range(70)}
    edges = [(f"p{a:02}", f"p{b:02}", 1) for a, b in pairs if a != b and a % 2 == b % 2]
    n = spark.createDataFrame(nodes, "id string, project_id string, type string, sources array<string>")
    found = G.related(n, spark.createDataFrame(edges, "source string, target string, times long"), 3, hub)
    got = {(r.id, r.other, round(r.relevance, 6), r.place) for r in found.collect()}
    assert got == brute_related(nodes, edges, 3) and len(got) == 180


def settled(labels, pairs):
    """Whether every page has the label of most weight around it, of equal ones the smallest."""
    votes = {}
    for a, b, w in pairs:
        for i, j in ((a, b), (b, a)):
            votes.setdefault(i, {}).setdefault(labels[j], 0)
            votes[i][labels[j]] += w
    return all(labels[i] == min(v, key=lambda c: (-v[c], c)) for i, v in votes.items())


def test_communities_settle_on_a_long_path_and_keep_unlinked_pages(spark):
    rng = random.Random(4)
    path = [(f"c{i:02}", f"c{i + 1:02}", 1.0 + i) for i in range(39)]  # the heavy end's label passes down the path, page by page
    some = {(min(a, b), max(a, b)): float(rng.randrange(1, 4)) for a, b in (rng.sample(range(40), 2) for _ in range(90))}
    pairs = path + [(f"r{a:02}", f"r{b:02}", w) for (a, b), w in some.items()] + [("x", "y", 1.0)]
    ids = sorted({i for p in pairs for i in p[:2]}) + ["alone"]
    got = G.communities(spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(pairs, "a string, b string, weight double")).collect()
    labels = {r.id: r.community for r in got}
    assert len(got) == len(ids) and set(labels) == set(ids) and labels["alone"] == "alone"
    assert settled(labels, pairs)
    assert labels["x"] == labels["y"] and not {labels[i] for i in ids if i[0] == "c"} & {labels[i] for i in ids if i[0] == "r"}
