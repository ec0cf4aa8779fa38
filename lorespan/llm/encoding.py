"""Encoding of a whole corpus with a public byte-pair vocabulary (problem 6)."""

from __future__ import annotations

from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lorespan.session import tokenizer_path


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col`` and ``ids ARRAY<INT>``: the token ids of each text, without special tokens.

    Method: the distinct words of a block of texts form a prefix trie, walked depth-first; each node's state, the last
    token of the encoding of its prefix, follows from its ancestors' states, so shared prefixes are encoded once
    (:mod:`lorespan.llm.trie_bpe`).  A worker keeps the encodings of the words it has seen.  No shuffle: every task
    encodes the texts of its own input split, whole texts of any length.

    Null and empty texts give an empty list, blank texts the ids of their white space.  Strings that spell a special
    token are ordinary text.  Repeated rows are encoded each; other columns, whatever their names, are not read.
    """
    path = vocabulary or tokenizer_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespan.llm.trie_bpe import encoder

        bpe = encoder(path)
        for batch in batches:
            ids, offsets = bpe.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])

    wanted = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    kind = wanted.schema["key"].dataType.simpleString()
    return wanted.mapInArrow(encode, f"key {kind}, ids array<int>").withColumnRenamed("key", id_col)
