import numpy as np
from helpers import compare

from lorespan.llm import catalogue
from lorespan.llm import neighbours as N

SCHEMA = "chunk_id string, embedding array<float>, upserted_at int, id int, vector string, rep string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, t, 0, "", "") for i, v, t in rows], SCHEMA)


def brute(vectors, k=5, least=0.9):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    pairs = set()
    for a, i in enumerate(ids):
        order = sorted((-round(float(x[a] @ x[b]), 12), j) for b, j in enumerate(ids) if b != a)[:k]
        pairs |= {(min(i, j), max(i, j)) for c, j in order if -c >= least}
    return pairs


def clustered(rng, groups, noise=0.25):
    rows = {}
    for g in range(groups):
        base = rng.normal(size=64)
        for m in range(rng.integers(1, 9)):
            v = base + noise * rng.normal(size=64)
            rows[f"g{g}#{m}"] = (v * rng.uniform(0.5, 3)).astype(np.float32).tolist()
    return rows


def found(spark, rows):
    return {tuple(r) for r in N.found_pairs(frame(spark, rows)).collect()}


def test_recall_against_brute_force(spark):
    vectors = clustered(np.random.default_rng(1), 300)
    want, got = brute(vectors), found(spark, [(i, v, 1) for i, v in vectors.items()])
    assert len(want) > 500 and len(want & got) >= 0.98 * len(want) and len(got - want) <= 0.01 * len(want)


def test_large_files_are_split(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    vectors = {f"c{i:03}": (base + 0.05 * rng.normal(size=64)).astype(np.float32).tolist() for i in range(300)}
    monkeypatch.setattr(N, "FILE_ROWS", 20)
    want, got = brute(vectors), found(spark, [(i, v, 1) for i, v in vectors.items()])
    assert len(want & got) >= 0.95 * len(want)


def test_files_of_several_pivots(spark, monkeypatch):
    """Large files are replaced by those of two and three pivots; the counts of all files stay below the limit but for dense ones."""
    vectors = clustered(np.random.default_rng(5), 500)
    monkeypatch.setattr(N, "FILE_ROWS", 60)
    want, got = brute(vectors), found(spark, [(i, v, 1) for i, v in vectors.items()])
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)


def test_postings(monkeypatch):
    perms = np.array([[0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]])
    files = N._Files(10)
    row, file = files.of(perms)
    assert sorted(zip(row.tolist(), file.tolist())) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 6), (1, 7), (1, 8), (1, 9)]
    files.large[0] = np.array([0, 1])
    row, file = files.of(perms[:1])
    assert sorted(file.tolist()) == [2, 3] + [10 + q for q in range(1, 7)] + [10 + 10 + q for q in range(2, 7)]
    files.large[1] = np.array([10 + 1])  # of 0 and 1
    row, file = files.of(perms[:1])
    assert sorted(f for f in file.tolist() if f >= 110) == [110 + 10 + q for q in range(2, 7)] and files.depth(file).max() == 3


def test_class_of_very_many_copies(spark):
    copies = spark.range(100_000).selectExpr("lpad(id, 6, '0') as chunk_id", "transform(sequence(1, 64), i -> float(i)) as embedding", "1 as upserted_at")
    other = spark.range(1).selectExpr("'x' as chunk_id", "transform(sequence(1, 64), i -> float(i + (i % 2))) as embedding", "1 as upserted_at")
    near = N.nearest_vectors(copies.unionByName(other))
    assert near.count() == 5 * 100_001 and near.where("neighbour > '000005'").count() == 0


def test_copies_are_one_class(spark):
    rng = np.random.default_rng(3)
    v, near = rng.normal(size=64), rng.normal(size=64)
    rows = [(f"k{i:02}", v.tolist(), 1) for i in range(40)] + [("near", (v + 0.1 * near).tolist(), 1)] + [(f"r{i}", rng.normal(size=64).tolist(), 1) for i in range(50)]
    got = found(spark, rows)
    want = brute({i: x for i, x, _ in rows})
    assert got == want and ("k00", "k39") in got and ("k38", "k39") not in got


def test_unusable_and_versions(spark):
    a, b = [1.0] * 64, [1.0] * 63 + [1.1]
    rows = [("a", a, 1), ("a", [float("nan")] * 64, 2), ("b", b, 2), ("b", [-1.0] * 64, 1), ("c", None, 1), ("d", [0.0] * 64, 1), ("e", [1.0] * 63, 1), ("f", [float("inf")] + a[1:], 1), ("g", [None] + a[1:], 1), (None, a, 1), ("a", a, 1)]
    assert found(spark, rows) == {("a", "b")}
    assert found(spark, []) == set() and found(spark, [("a", a, 1)]) == set()


def test_footrule():
    perms = np.array([[0, 1, 2, 3], [0, 1, 2, 3], [3, 2, 1, 0], [7, 8, 9, 6]], dtype=np.int32)
    assert N.footrule_similarity(perms, np.array([0, 0, 0]), np.array([1, 2, 3])).tolist() == [10, 1 + 2 + 2 + 1, 0]


def test_found_equals_sql(spark, data):
    compare(spark, data, catalogue.QUERIES["p1_found"], catalogue.SQL["p1_found"])
