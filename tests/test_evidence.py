import re

import pytest
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.operators import evidence as E
from lorespan.operators import graph as G
from lorespan.operators import search as S


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "text string").select(*columns).first()


@pytest.mark.parametrize(
    "text, safe",
    [
        ("see brisk-window-dadipela and task-force-assessment", "see brisk-window-dadipela and task-force-assessment"),
        ("key sk-abcdefghij1234 here", "key [REDACTED:secret] here"),
        ("sk-proj-abcdefghij1234, ghp_abcdefghijklmnopqrst and xoxb-1234567890", "[REDACTED:secret], [REDACTED:secret] and [REDACTED:secret]"),
        ("MY_API_KEY = abc, other", "MY_API_KEY = [REDACTED:secret], other"),
        ("password: hunter2", "password: [REDACTED:secret]"),
        ("https://user:pw@host/path", "https://[REDACTED:secret]@host/path"),
        ("Authorization: Bearer abcdefgh12345", "Authorization: Bearer [REDACTED:secret]"),
        ("a <private note>x\ny</PRIVATE> b", "a <private>[REDACTED:private]</private> b"),
        ("nothing, nothing at all", "nothing, nothing at all"),
        ("", ""),
    ],
)
def test_redaction(spark, text, safe):
    assert one(spark, text, T.redacted(F.col("text")))[0] == safe


@pytest.mark.parametrize("text", ["", "a", "é", "中", "😀", "Ångström 😀 中文"])
def test_fnv_over_code_points(spark, text):
    value = 2166136261
    for c in text:
        value = (value ^ ord(c)) * 16777619 & 0xFFFFFFFF
    digits = ""
    while value:
        value, digit = divmod(value, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[digit] + digits
    assert one(spark, text, T.fnv36(F.col("text")))[0] == (digits or "0")


def test_front_matter(spark):
    text = "\ufeff\r\nnote\r\n---\r\ntitle: \"A: b\"\r\ntags: [x, 'y', ]\r\nsources:\r\n  - one.pdf\r\n- two-b.pdf\r\nrelated: [[a]], [[b c]]\r\nempty:\r\n---\r\nBody\r\n---\r\n"
    fields, body = one(spark, text, T.front_matter(F.col("text")), T.page_body(F.col("text")))
    assert [(f.field, f.entries) for f in fields] == [("title", ["A: b"]), ("tags", ["x", "y"]), ("sources", ["one.pdf", "two-b.pdf"]), ("related", ["[[a]]", "[[b c]]"]), ("empty", [])]
    assert body == "Body\r\n---\r\n"


def test_front_matter_starts_within_six_lines(spark):
    block = "---\na: b\n---\n"
    for lines, found in ((5, 1), (6, 0)):
        assert len(one(spark, "x\n" * lines + block, T.front_matter(F.col("text")))[0]) == found
    assert one(spark, "---\nno end", T.page_body(F.col("text")))[0] == "---\nno end"


def test_links_outside_code(spark):
    text = "[[a]] `[[b]]` [[c d|e]] ```\n[[f]]\n``` ` [[g|]]"
    assert one(spark, text, T.outside_code(F.col("text"), T.markdown_links))[0] == "[a](#a) `[[b]]` [e](#c d) ```\n[[f]]\n``` ` [g](#g)"


def test_words_of_chinese_beyond_the_basic_plane(spark):
    assert one(spark, "𠀀中文", T.tokens(F.col("text")))[0] == ["𠀀中", "中文", "𠀀", "中", "文", "𠀀中文"]


def test_fusion_counts_words_once(spark):
    rows = [(1, "lexical", 1), (1, "bm25", 1), (2, "bm25", 2), (3, "vector", 1), (1, "vector", 3)]
    got = S.fuse([spark.createDataFrame(rows, "doc_id long, stream string, place long")], instead={"bm25": "lexical"})
    assert {r.doc_id: pytest.approx(r.score) for r in got.collect()} == {1: 1 / 61 + 1 / 63, 2: 1 / 62, 3: 1 / 61}


def test_ranks_are_those_of_one_sort(spark):
    rows = [(i, float(i * 7 % 5)) for i in range(200)]
    got = {r.doc_id: r.place for r in S.ranked(spark.createDataFrame(rows, "doc_id long, score double"), "x").collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert S.ranked(spark.createDataFrame([], "doc_id long, score double"), "x").count() == 0


def test_bm25_on_five_fields(spark):
    import math

    rows = [(1, "claim-index", "claim claim other", "index"), (2, "x", "other words claim", ""), (3, "y", "none", "index")]
    df = spark.createDataFrame(rows, "doc_id long, name string, body string, tags string")
    fields = {"filename": F.col("name"), "body": F.col("body"), "keywords": F.col("tags")}
    got = {r.doc_id: r.score for r in S.bm25(df.select("doc_id", *S.bm25_counts(fields, ["claim", "index"])), list(fields), ["claim", "index"]).collect()}
    texts = {"filename": [["claim", "index"], [], []], "body": [["claim", "claim", "other"], ["other", "words", "claim"], ["none"]], "keywords": [["index"], [], ["index"]]}
    want = {}
    for f, weight in (("filename", 4), ("body", 1), ("keywords", 2)):
        average = sum(map(len, texts[f])) / 3
        for q in ("claim", "index"):
            df_ = sum(q in t for t in texts[f])
            for i, t in enumerate(texts[f], 1):
                if n := t.count(q):
                    want[i] = want.get(i, 0) + weight * math.log(1 + (3 - df_ + 0.5) / (df_ + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t) / average))
    assert got == pytest.approx(want)


def test_degree_counts_both_directions(spark):
    edges = spark.createDataFrame([("a", "c", 1), ("c", "a", 1), ("b", "c", 1), ("a", "b", 1)], "source string, target string, times long")
    got = {(r.a, r.b): r.adamic_adar for r in G.adamic_adar(G.undirected_edges(edges)).collect()}
    import math

    assert got == pytest.approx({("a", "b"): 1 / math.log(3), ("a", "c"): 1 / math.log(2), ("b", "c"): 1 / math.log(3)})


def test_claim_evidence(spark):
    claims = spark.createDataFrame([(1, "wiki/a.md", "Index of claims", 0.8, "ok"), (2, "wiki/a.md", "other", 2.0, "stale"), (3, "wiki/b.md", "index", None, "odd"), (4, "wiki/c.md", "index", 1.0, "ok")], "claim_id long, path string, text string, confidence double, status string")
    results = spark.createDataFrame([("wiki/a.md", 1), ("wiki/b.md", 4)], "path string, place int")
    got = [(r.claim_id, r.score, r.matched) for r in E.claim_evidence(claims, results, ["index", "claim"]).collect()]
    assert got == [(1, pytest.approx(1 + 1 + 0.28 + 0.2), "index claim"), (2, pytest.approx(1 + 0.35 - 0.12), ""), (3, pytest.approx(0.25 + 0.5 - 0.25), "index")]


def brute_snippets(text, most, step):
    trim = lambda xs: [x.strip(" \t\r\n") for x in xs if x.strip(" \t\r\n")]
    out = []
    for block in trim(re.split(r"\n{2,}", text.replace("\r\n", "\n"))):
        if len(block) <= most:
            out.append(block)
            continue
        windows, current = [], ""
        for s in trim(re.split(r"\n+", re.sub(r"([.!?。！？；;])\s+", "\\1\n", block))):
            if current and len(current) + 1 + len(s) > most:
                windows.append(current)
                current = s
            else:
                current = f"{current} {s}" if current else s
        for w in [*windows, current]:
            out += [w] if len(w) <= most else trim(w[i : i + most] for i in range(0, len(w), step))
    return out


def test_snippets(spark):
    text = "Short one.\r\n\r\n" + "A sentence of words. " * 9 + "Then " + "long" * 40 + "! End.\n\n \n\nlast"
    assert one(spark, text, E.snippets(F.col("text"), 60, 40))[0] == brute_snippets(text, 60, 40)
    assert one(spark, "", E.snippets(F.col("text")))[0] == []


def test_snippet_provenance(spark):
    claims = spark.createDataFrame([(1, "p", "The *second* paragraph, here"), (2, "p", "paragraph first shares words unseen"), (3, "p", "nothing alike"), (4, "q", "x"), (5, "p", " "), (6, "p", None)], "claim_id long, path string, text string")
    docs = spark.createDataFrame([(9, "p", "First paragraph shares its words.\n\nThis is the second paragraph here."), (8, "p", "other text"), (7, "p", None)], "doc_id long, path string, text string")
    got = {r.claim_id: (r.doc_id, r.place, r.score) for r in E.snippet_provenance(claims, docs).collect()}
    assert got == {1: (9, 1, 1.0), 2: (9, 0, 0.8)}


def test_reference_rewrites(spark):
    page = lambda slug, content: {"slug": slug, "page_path": None, "content": content}
    requests = spark.createDataFrame([("new-page", [page("old-page", "---\ntitle: Old Name\naliases: [O P]\n---\n"), page("new-page", None)]), (None, [page("z", None)]), ("y", None)], "canonical_slug string, merge_group array<struct<slug string, page_path string, content string>>")
    docs = spark.createDataFrame([(1, "[[Old Page|x]] [[o_p]] [[old-page]] [[old-page]] [[new-page]]"), (2, "[[z]]"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, E.reference_rewrites(docs, E.redirects(requests)).collect()))
    assert got == [(1, "Old Page", "new-page", 1), (1, "o_p", "new-page", 1), (1, "old-page", "new-page", 2)]


def test_expanded(spark):
    hits = spark.createDataFrame([("a", 1), ("b", 2)], "id string, place int")
    related = spark.createDataFrame([("a", "b", 9.0), ("a", "c", 3.0), ("b", "c", 5.0), ("b", "d", 1.9), ("c", "e", 7.0)], "id string, other string, relevance double")
    assert [tuple(r) for r in E.expanded(hits, related).collect()] == [("c", 3.0)]
