import random

import duckdb
from helpers import compare
from pyspark.sql import functions as F

from lorespan.operators import pages as P
from lorespan.plans import pages as plans


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_claim_anchors(spark):
    got = P.claim_anchors(docs(spark, "<!-- claim:a-1 -->\r\n\r\n<!-- other -->\r\n- The  claim. \r\nmore", "text <!-- claim:b --> no line of its own", "x\n  <!-- claim:c_2 -->", None, "")).collect()
    assert sorted(map(tuple, got)) == [(0, 1, "a-1", "The  claim."), (2, 2, "c_2", "")]


def test_reviews(spark):
    text = "a ---REVIEW: Duplicate | Two pages ---\nSame thing.\nOPTIONS: Merge | Skip\nPAGES: a.md, b.md\nSEARCH: x | \n---END REVIEW--- ---REVIEW: odd | T ---\nbody\n---END REVIEW---\n---REVIEW: open | no end ---\n"
    got = [r.asDict() for r in P.reviews(docs(spark, text, None, "none")).collect()]
    assert got == [
        {"doc_id": 0, "place": 0, "kind": "duplicate", "title": "Two pages", "options": ["Merge", "Skip"], "pages": ["a.md", "b.md"], "searches": ["x"], "description": "Same thing."},
        {"doc_id": 0, "place": 1, "kind": "confirm", "title": "T", "options": ["Approve", "Skip"], "pages": [], "searches": [], "description": "body"},
    ]


def test_trimmed_index(spark):
    text = "# top\n## Head\n- claim one\n- other\n- a very long line about a claim\n- index"
    df = docs(spark, text, "short", None)
    got = [r[0] for r in df.select(P.trimmed_index(F.col("text"), ["claim", "index"], 30)).collect()]
    assert got == ["## Head\n- claim one\n- index", "short", None]


def test_embedding_texts(spark):
    chunks = spark.createDataFrame([("a#0", "a", " H > I ", "text\n"), ("b#0", "b", None, "t"), ("c#0", "a", "", None)], "chunk_id string, page_id string, heading_path string, chunk_text string")
    titles = spark.createDataFrame([("a", "Title")], "page_id string, title string")
    assert sorted(map(tuple, P.embedding_texts(chunks, titles).collect())) == [("a#0", "Title\n\nH > I\n\ntext"), ("b#0", "t"), ("c#0", "Title")]


def test_name_candidates_equal_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ab-") for _ in range(rng.randint(1, 6)))
    keys = [("pq"[i % 2], word(), f"id{i:02}") for i in range(30)]
    names = sorted({("pq"[i % 2], word()) for i in range(40)})
    got = {tuple(r) for r in P.name_candidates(spark.createDataFrame(names, "project_id string, name string"), spark.createDataFrame(keys, "project_id string, key string, id string")).collect()}
    want = {(p, n, min(ids)) for p, n in names if (ids := [i for q, k, i in keys if q == p and (n in k or k in n)])}
    assert got == want and len(want) > 20


def test_name_candidates_broadcast_no_parts(spark):
    """Spark takes all parts of names or keys for as small as those are; beside one row none is broadcast."""
    key = lambda i: f"{i * 7919:06}-some-longer-key-of-a-page-{i * 104729:07}"
    keys = spark.createDataFrame([("p", key(i), f"id{i:03}") for i in range(200)], "project_id string, key string, id string")
    names = spark.createDataFrame([("p", f"x{key(i)}" if i % 2 else key(i)[1:]) for i in range(200)], "project_id string, name string")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "256k")
    try:
        got = {r["name"]: r["candidate"] for r in P.name_candidates(names, keys).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert got == {(f"x{key(i)}" if i % 2 else key(i)[1:]): f"id{i:03}" for i in range(200)}


def test_name_candidates_of_all_lengths(spark):
    keys = ["a", "ab", "abc", "abcd", "abcdefg", "abcdefgh", "abcdefghij" * 3, "é-ü", "z"]
    names = ["xa", "b", "cde", "bcdefgh", "hijabcdefghija", "xabcdefghx", "-é-ü-", "ü", "q", "yz" * 200]
    got = P.name_candidates(spark.createDataFrame([("p", n) for n in names] + [(None, "a")], "project_id string, name string"), spark.createDataFrame([("p", k, f"id{i}") for i, k in enumerate(keys)] + [(None, "a", "none")], "project_id string, key string, id string"))
    want = {("p", n, min(ids)) for n in names if (ids := [f"id{i}" for i, k in enumerate(keys) if n in k or k in n])}
    assert {tuple(r) for r in got.collect()} == want and len(want) == 9


def test_target_candidates_of_findings_in_two_projects(spark, data, tmp_path):
    duckdb.sql(f"COPY (FROM '{data}/retrieval_nodes.parquet') TO '{tmp_path}/retrieval_nodes.parquet'")
    findings = f"'{data}/schema_drift_findings.parquet'"
    duckdb.sql(f"COPY (FROM {findings} UNION ALL SELECT * REPLACE ((SELECT max(project_id) FROM {findings}) AS project_id) FROM {findings}) TO '{tmp_path}/schema_drift_findings.parquet'")
    compare(spark, str(tmp_path), plans.target_candidates, plans.SQL["target_candidates"])
