from datetime import datetime as D

from pyspark.sql import functions as F

from lorespan.functions.links import reference_key
from lorespan.operators.orphans import orphan_references, orphan_report, page_sources

NODE = "row_id long, node_id string, project_id string, aliases array<string>, out_links array<string>, created_at timestamp, deleted_at timestamp, indexed_at timestamp, salt int, at string"
LINT = "lint_id long, project_id string, affected_pages array<string>, run_at timestamp, row_id long"
DRIFT = "finding_id long, project_id string, relation_target string, detected_at timestamp"


def day(n):
    return D(2025, 1, n)


def tables(spark, nodes=(), lint=(), drift=()):
    return spark.createDataFrame(list(nodes), NODE), spark.createDataFrame(list(lint), LINT), spark.createDataFrame(list(drift), DRIFT)


def found(spark, *rows):
    nodes, lint, drift = tables(spark, *rows)
    result = orphan_references(page_sources(nodes, lint, drift), nodes)
    return sorted((r.ref_table, r.ref_id, r.target_key, r.kind, r.depth) for r in result.collect())


def test_reference_key(spark):
    cases = {" [[A  b_c]] ": "a-b-c", "x/y/Page.md": "page", "[[a|b]]": "a", "a#b": "a", "[[a]] b": "[[a]]-b", "http://x": None, "": None, None: None, "--": None, "a.md#x": "a", "[[#x]]": None}
    rows = spark.createDataFrame([(k,) for k in cases], "link string").select("link", reference_key(F.col("link")).alias("key")).collect()
    assert {r.link: r.key for r in rows} == cases


def test_direct_and_inherited(spark):
    nodes = [
        (1, "a", "p", None, ["b"], day(1), None, day(2), 0, ""),
        (2, "b", "p", ["Bee"], ["c", None, "https://x.y"], day(1), None, day(2), 0, ""),
        (3, "c", "p", [], ["gone"], day(1), None, day(2), 0, ""),
        (4, "d", "p", [], [], day(1), day(5), day(2), 0, ""),
        (4, "d", "p", [], [], day(1), day(5), day(2), 0, ""),
        (5, "e", "q", None, ["a", "f"], day(1), None, day(2), 0, ""),
        (6, "f", "q", None, ["f", "e"], day(1), None, day(2), 0, ""),
        (7, "g", "p", None, ["h"], day(1), None, day(2), 0, ""),
        (8, "h", "p", None, ["g", "d"], day(1), None, day(2), 0, ""),
    ]
    lint = [(1, "p", ["BEE", "bee"], day(3), 9), (1, "p", ["BEE", "bee"], day(3), 9), (2, "p", None, day(3), 9), (3, None, ["a"], day(3), 9), (4, "p", ["d"], day(5), 9), (5, "p", ["d"], day(4), 9), (6, "p", ["d"], None, 9)]
    drift = [(1, "p", "[[C]]", day(3)), (2, "p", None, day(3)), (3, "p", "a", D(2024, 1, 1))]
    assert found(spark, nodes, lint, drift) == [
        ("lint_results", 1, "bee", "inherited", 2), ("lint_results", 3, "a", "direct", 0), ("lint_results", 4, "d", "direct", 0), ("lint_results", 6, "d", "direct", 0),
        ("retrieval_nodes", 1, "b", "inherited", 2), ("retrieval_nodes", 2, "c", "inherited", 1), ("retrieval_nodes", 3, "gone", "direct", 0),
        ("retrieval_nodes", 5, "a", "direct", 0), ("retrieval_nodes", 5, "f", "inherited", 2), ("retrieval_nodes", 6, "e", "inherited", 1), ("retrieval_nodes", 6, "f", "inherited", 2),
        ("schema_drift_findings", 1, "c", "inherited", 1), ("schema_drift_findings", 3, "a", "direct", 0),
    ]


def test_empty_tables_and_report(spark):
    assert found(spark) == []
    nodes, lint, drift = tables(spark, [(1, "a", "p", None, ["x", "y"], day(1), None, day(2), 0, "")])
    report = orphan_report(orphan_references(page_sources(nodes, lint, drift), nodes)).collect()
    assert [tuple(r) for r in report] == [("retrieval_nodes", "2025-01", 2, 0, 1, 1)]


def test_hot_key_is_salted(spark, monkeypatch):
    from lorespan.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    nodes = [(1, "hot", "p", None, None, day(1), day(9), day(2), 0, "")]
    lint = [(i, "p", ["hot"], day(2 if i % 2 else 10), 0) for i in range(200)]
    assert [r[1] for r in found(spark, nodes, lint)] == [i for i in range(200) if i % 2 == 0]
