import random

from lorespan.operators import search as S


def test_fusion_counts_every_place(spark):
    rng = random.Random(6)
    ids = [f"d{i:03}" for i in range(300)]
    streams = {name: {i: rng.randrange(40) for i in rng.sample(ids, 250)} for name in ("one", "two")}
    places = {name: {i: n for n, i in enumerate(sorted(s, key=lambda i: (-s[i], i)), 1)} for name, s in streams.items()}
    ranked = [S.ranked(spark.createDataFrame(list(s.items()), "doc_id string, score int"), name) for name, s in streams.items()]
    got = {r.doc_id: (round(r.score, 12), r.places) for r in S.fuse(ranked).collect()}
    want = {i: {name: p[i] for name, p in places.items() if i in p} for i in ids if any(i in p for p in places.values())}
    assert got == {i: (round(sum(1 / (60 + n) for n in p.values()), 12), p) for i, p in want.items()}
