import pytest

from lorespan.sources import jsonl, pages, vectors


def test_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a page.md").write_text("---\nsources: [\"Paper.pdf\"]\n---\nx\ny")
    (tmp_path / "b.txt").write_text("no")
    read = pages.read_pages(spark, str(tmp_path))
    row = read.collect()
    assert [(r.page_id, r.file_name, r.content.endswith("x\ny")) for r in row] == [("a page", "a page.md", True)]
    assert pages.related_pages(read, "paper.pdf").count() == 1 and pages.related_pages(read, "other.pdf").count() == 0


def test_log_keeps_every_line(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\nbroken\n\n[1]\n{"a": "no"}\n')
    good, bad = jsonl.read_log(spark, str(tmp_path), {"a": "long", "b": "string"})
    assert sorted((r.a, r.b) for r in good.collect() if r.a) == [(1, "x")] and good.count() == 2
    assert sorted(r.raw for r in bad.collect()) == ["[1]", "broken"]
    jsonl.append_log(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).collect()[0][0] == '{"a":1}'
    jsonl.export_csv(spark.createDataFrame([('q"x', 1)], "s string, n int").coalesce(1), str(tmp_path / "csv"), ["s", "n"])
    assert [r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["s,n", '"q""x",1']


def test_vector_table(spark):
    kind = "chunk_id string, page_id string, vector array<float>"
    old = spark.createDataFrame([("a#0", "a", [1.0, 2.0]), ("a#1", "a", [1.0, 2.0]), ("b#0", "b", [1.0, 2.0])], kind)
    new = spark.createDataFrame([("a#0", "a", [3.0, 4.0])], kind)
    assert sorted((r.chunk_id, r.vector[0]) for r in vectors.upserted(old, new, 2).collect()) == [("a#0", 3.0), ("b#0", 1.0)]
    assert vectors.upserted(old, new.limit(0), 2).count() == 3
    assert vectors.deleted(old, old.where("page_id = 'a'")).count() == 1
    with pytest.raises(Exception, match="unfit chunk"):
        vectors.upserted(old, new, 3).collect()
