import pytest
from helpers import compare

from lorespan.llm import catalogue
from lorespan.llm.splitting import split_corpus
from lorespan.llm.trie_bpe import TrieEncoder
from lorespan.session import tokenizer_path


def checked(spark, texts, limit=512, overlap=64):
    bpe = TrieEncoder(tokenizer_path())
    size = lambda t: len(bpe.encode([t])[0])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = {}
    for r in sorted(split_corpus(df, limit=limit, overlap=overlap).collect(), key=lambda r: (r.doc_id, r.piece)):
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(texts):
        if not text or size(text) <= limit:
            assert i not in pieces
            continue
        before = 0
        assert [p.piece for p in pieces[i]] == list(range(len(pieces[i])))
        for p in pieces[i]:
            assert p.start <= before < p.end and p.piece_text == text[p.start : p.end]
            assert size(p.piece_text) == p.n_tokens <= limit
            assert size(text[p.start : before]) == p.overlap_tokens <= overlap
            before = p.end
        assert before == len(text)
    return pieces


def test_documents(spark, data):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    pieces = checked(spark, texts)
    ends = [p.ends_at for own in pieces.values() for p in own[:-1]]
    assert sum(e in ("sentence", "line", "paragraph", "heading") for e in ends) > 0.8 * len(ends)


def test_hard_texts(spark):
    texts = [None, "", "   ", "short", "a" * 20000, "あ" * 3000, "👩‍👩‍👧" * 900, " " * 5000, "\n" * 4000, "!'s" * 3000, "x\r\n" * 2000, "One two. " * 1500, "# H\n\ntext of it.\n\n" * 400, "| a | b |\n" * 900, "    \n\t x" * 900]
    checked(spark, texts)
    checked(spark, texts, 64, 0)
    checked(spark, texts, 100, 50)


def test_prefers_natural_boundaries(spark):
    pieces = checked(spark, ["word " * 30 + "\n\n# Next one\n" + "word " * 60], 64, 8)[0]
    assert [p.ends_at for p in pieces][0] == "line" and pieces[0].piece_text.endswith("# Next one\n")
    assert checked(spark, ["word " * 50 + "\n\n# Next" + " word" * 60], 64, 8)[0][0].ends_at == "heading"


def test_limits_are_checked(spark):
    with pytest.raises(ValueError):
        split_corpus(spark.createDataFrame([(1, "a")], "doc_id long, text string"), limit=100, overlap=60)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a. " * 600, 3, "x")], "doc_id long, text string, piece int, key string")
    assert split_corpus(df).count() >= 2 and split_corpus(df.limit(0)).count() == 0 and split_corpus(df.union(df)).count() == 2 * split_corpus(df).count()


def test_rebuilt_equals_sql(spark, data):
    compare(spark, data, catalogue.QUERIES["p8_rebuilt"], catalogue.SQL["p8_rebuilt"])
