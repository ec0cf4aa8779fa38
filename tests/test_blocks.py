from lorespan.functions import blocks as B


def test_file_blocks():
    text = "x\r\n---FILE: wiki/a.md---\r\nhi\n```\n---END FILE---\n```\n--- end file ---\n---FILE: ../b---\nno\n---END FILE---\n---FILE:  ---\n---END FILE---\n---FILE: wiki/c.md---\ncut"
    assert [(p, c.count("\n"), e) for p, c, e in B.file_blocks(text)] == [("wiki/a.md", 3, ""), ("../b", 0, "unsafe-path"), ("", 0, "empty-path"), ("wiki/c.md", 0, "truncated")]
    assert list(B.file_blocks("")) == []


def test_chunks_keep_fences_and_headings():
    code = "```\n" + "# no heading\n" * 200 + "```\n"
    text = "---\ntitle: x\n---\nIntro.\n\n# A\n\n" + "Sentence here. " * 200 + "\n\n## B\n\n" + code + "\n| a | b |\n| - | - |\n"
    got = list(B.chunks(text))
    assert got[0][0] == "Intro." and got[0][1] == ""
    assert {c[1] for c in got} == {"", "# A", "# A > ## B"}
    assert [c for c in got if c[4]][0][0] == code.strip()
    for chunk, _, a, b, over in got:
        assert text[a:b].strip() == chunk and (over or len(chunk) <= 1500)
    covered = set().union(*(range(a, b) for _, _, a, b, _ in got))
    assert not {i for i, c in enumerate(text) if c.isalnum() and i > 18} - covered - {i for i in range(len(text)) if text[i] in "AB"}


def test_long_unbroken_text():
    got = list(B.chunks("x" * 5000))
    assert "".join(c[0][-(c[3] - c[2] - (200 if i else 0)) :] for i, c in enumerate(got)) == "x" * 5000 and all(len(c[0]) <= 1500 for c in got)


def test_review_headers_after_other_text(spark, tmp_path):
    from lorespan.plans.blocks import review_blocks

    texts = ["---REVIEW: duplicate | A---\nx\n---END REVIEW--- ---REVIEW: Missing-Page | B ---\ny\n---END REVIEW---", "text ---REVIEW: odd_kind2 | a---\n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in review_blocks(spark, str(tmp_path)).collect()}
    assert got == {("duplicate", "a", 1, 1), ("missing-page", "b", 1, 1), ("confirm", "a", 1, 1)}
