import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespan.llm.encoding import encode_corpus
from lorespan.llm.trie_bpe import SPLIT_PATTERN, TrieEncoder
from lorespan.session import tokenizer_path


@pytest.fixture(scope="module")
def bpe():
    return TrieEncoder(tokenizer_path())


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(bpe, texts):
    ids, at = bpe.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


def test_edge_cases(bpe, plain):
    texts = [None, "", " ", "\n\n \t", "<|endoftext|>", "a" * 5000, "あ" * 3000, "x1" * 500, "don't I'll", "a\r\nb  c", "​﻿", "😀😀", " " * 300 + "x", "=" * 1000]
    assert encoded(bpe, texts) == [plain.encode_ordinary(t) if t else [] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_equals_reference_library(bpe, plain, texts):
    assert encoded(bpe, texts) == [plain.encode_ordinary(t) for t in texts]


def test_forgetting_changes_nothing(bpe, plain, monkeypatch):
    import lorespan.llm.trie_bpe as m

    monkeypatch.setattr(m, "CACHE_WORDS", 3)
    monkeypatch.setattr(m, "BLOCK_CHARS", 10)
    texts = [f"word{i} common words here {i * 7919}" for i in range(50)]
    assert encoded(bpe, texts) == [plain.encode_ordinary(t) for t in texts]


def test_words_share_prefixes(bpe):
    words = sorted([b"inter", b"international", b"internet", b"i", b"nation"])
    got = list(bpe.encode_sorted(words))
    assert [b"".join(bpe.bytes_of[t] for t in ids) for ids in got] == words


def test_corpus(spark, data, plain):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = encode_corpus(docs).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts) and all(r.ids == (plain.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else []) for r in rows)


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b", "z", 5), (1, "a b", "z", 5), (None, None, None, None)], "doc_id long, text string, key string, ids int")
    assert sorted((str(r.doc_id), len(r.ids)) for r in encode_corpus(df).collect()) == [("1", 2), ("1", 2), ("None", 0)]
    assert encode_corpus(df.limit(0)).collect() == []
