"""Splitting of oversized texts at natural boundaries, with an overlap (problem 8)."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorespan.session import tokenizer_path

#: What a piece may end at, from the weakest to the strongest; ``natural`` begins with the sentence.
KINDS = ("inside", "word", "sentence", "line", "paragraph", "heading", "end")
NATURAL = 2

#: Ends of sentences: stops of several scripts with closing marks, before white space (or anything, after full-width stops).
SENTENCE = regex.compile(r"""(?:[.!?…؟۔।॥]+["'”’»)\]]*(?=\s)|[。！？｡]+["'”’»）」』】]*)""")
LINE_END = regex.compile(r"\r\n|\n|\r")
HEADING = regex.compile(r" {0,3}#{1,6}[ \t]")
BLANK = regex.compile(r"[^\S\r\n]*(?:\r|\n|$)")

#: Unbroken words of more tokens than this can be cut inside, between characters.
INSIDE = 16

#: Tokens left free in each piece at first: where a text is cut, white space at the seam may encode otherwise.
SEAM = 2


def _natural(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places after which a piece may naturally end, and their kinds."""
    place, kind = [], []
    for m in SENTENCE.finditer(text):
        place.append(m.end())
        kind.append(2)
    blank_before = False
    for m in LINE_END.finditer(text):
        at = m.end()
        if BLANK.match(text, at):  # an empty line follows: the paragraph ends after it
            blank_before = True
            place.append(at)
            kind.append(3)
            continue
        place.append(at)
        kind.append(5 if HEADING.match(text, at) else 4 if blank_before else 3)
        blank_before = False
    return np.array(place, dtype=np.int64), np.array(kind, dtype=np.int8)


def _inner_cuts(bpe, text: str, words: list[str], numbers: np.ndarray, ends: np.ndarray, sizes: np.ndarray, at: np.ndarray, place: np.ndarray, kind: np.ndarray):
    """Boundaries inside words: natural ones, in runs of white space, and those of very long words.

    Gives (word, cuts, kinds, tokens of the parts or None); the tokens of an encoding stay apart wherever it is cut, so
    parts that end at its tokens need no encoding of their own.
    """
    natural: dict[int, dict[int, int]] = {}
    for i, p, k in zip(at.tolist(), place.tolist(), kind.tolist()):
        own = natural.setdefault(i, {})
        own[p] = max(k, own.get(p, 0))
    for i in sorted({*natural, *np.flatnonzero(sizes > INSIDE).tolist()}):
        own, counts = natural.get(i, {}), None
        if sizes[i] > INSIDE:
            begin, chars, raw, taken, parts, cuts = int(ends[i]) - len(words[i]), 0, b"", 0, [], []
            for token in bpe.tokens(numbers[i : i + 1]).tolist():
                raw += bpe.bytes_of[token]
                taken += 1
                if taken >= INSIDE:
                    try:
                        chars += len(raw.decode("utf-8"))
                    except UnicodeDecodeError:
                        continue
                    if begin + chars < ends[i]:
                        cuts.append(begin + chars)
                        parts.append(taken)
                        raw, taken = b"", 0
            if not own:
                counts = [*parts, int(sizes[i]) - sum(parts)]
            own = dict.fromkeys(cuts, 0) | own
        if own:
            cuts = sorted(own)
            yield i, cuts, [own[c] for c in cuts], counts


def _boundaries(bpe, texts: list[str], words: list[list[str]], numbers: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the places of all possible boundaries, the tokens up to each, and their kinds."""
    tables, unknown = [], []
    for text, own, number in zip(texts, words, numbers):
        ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)))
        sizes = bpe.token_counts(number)
        kinds = np.ones(len(own), dtype=np.int8)
        place, kind = _natural(text)
        keep = (place > 0) & (place < len(text))
        place, kind = place[keep], kind[keep]
        at = np.searchsorted(ends, place)
        exact = ends[at] == place
        np.maximum.at(kinds, at[exact], kind[exact])
        inner = list(_inner_cuts(bpe, text, own, number, ends, sizes, at[~exact], place[~exact], kind[~exact]))
        for i, cuts, _, counts in inner:
            if counts is None:
                edges = [int(ends[i]) - len(own[i]), *cuts, int(ends[i])]
                unknown += [text[a:b] for a, b in zip(edges, edges[1:])]
        tables.append((ends, sizes, kinds, inner))
    known = iter(bpe.token_counts(bpe.word_numbers(unknown)).tolist() if unknown else [])
    done, zero = [], np.zeros(1, dtype=np.int64)
    for ends, sizes, kinds, inner in tables:
        new_at, new_end, new_kind, new_size = [], [], [], []
        for i, cuts, own_kinds, counts in inner:
            counts = counts or [next(known) for _ in range(len(cuts) + 1)]
            new_at += [i] * len(cuts)
            new_end += cuts
            new_kind += own_kinds
            new_size += counts[:-1]
            sizes[i] = counts[-1]
        if new_at:
            ends, kinds, sizes = np.insert(ends, new_at, new_end), np.insert(kinds, new_at, new_kind), np.insert(sizes, new_at, new_size)
        kinds[-1] = len(KINDS) - 1
        done.append((np.concatenate([zero, ends]), np.concatenate([zero, np.cumsum(sizes)]), np.concatenate([zero, kinds])))
    return done


def _cuts(tokens: np.ndarray, kinds: np.ndarray, first: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """The boundaries at which the texts of a block are cut, and for every boundary where the piece after it begins.

    ``tokens`` rises over all boundaries of the block (between texts by more than ``limit``); ``first`` are the texts' starts.
    """
    n, all_ = len(tokens), np.arange(len(tokens))
    last_of = np.repeat(np.append(first[1:], n) - 1, np.diff(np.append(first, n)))
    # Where the piece after each boundary begins: as early as the overlap allows, at a word if there is one.
    begin = np.searchsorted(tokens, tokens - overlap)
    word_after = np.minimum.accumulate(np.where((kinds >= 1) | np.isin(all_, first), all_, n)[::-1])[::-1]
    begin = np.where(word_after[begin] < all_, word_after[begin], begin)
    # Every boundary's farthest legal successor: the last natural one in reach, else the last word, else any.
    reach = np.minimum(np.searchsorted(tokens, tokens[begin] + limit, side="right") - 1, last_of)
    natural = np.maximum.accumulate(np.where(kinds >= NATURAL, all_, -1))[reach]
    word = np.maximum.accumulate(np.where(kinds >= 1, all_, -1))[reach]
    jump = np.where(natural > all_, natural, np.where(word > all_, word, np.maximum(reach, np.minimum(all_ + 1, last_of))))
    jump = np.where(all_ == last_of, all_, jump)
    # Pointer doubling: after k rounds the first 2**k cuts of every text are marked.
    cuts = first
    while True:
        more = np.union1d(cuts, jump[cuts])
        if len(more) == len(cuts):
            return cuts, begin
        cuts, jump = more, jump[jump]


def _pieces(bpe, texts: list[str], words: list[list[str]], numbers: list[np.ndarray], limit: int, overlap: int) -> Iterator[tuple[int, list[tuple]]]:
    """(index, pieces) of each text; a piece is (start, end, tokens, tokens repeated, kind of its end)."""
    todo, spare = list(range(len(texts))), SEAM
    while todo:
        tables = _boundaries(bpe, [texts[i] for i in todo], [words[i] for i in todo], [numbers[i] for i in todo])
        lengths = [len(t[0]) for t in tables]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        tokens, shift = [], 0
        for t in tables:
            tokens.append(t[1] + shift)
            shift = int(tokens[-1][-1]) + limit + overlap + 1
        place = np.concatenate([t[0] for t in tables])
        kinds = np.concatenate([t[2] for t in tables])
        cuts, begin = _cuts(np.concatenate(tokens), kinds, first, limit - spare, max(overlap - spare, 0))
        owner = np.searchsorted(first, cuts, side="right") - 1
        ends = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        doc, start, end, kind = owner[ends], place[begin[cuts[ends - 1]]], place[cuts[ends]], kinds[cuts[ends]]
        before = place[cuts[ends - 1]]
        own = [texts[todo[d]][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist())]
        again = [texts[todo[d]][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), before.tolist())]
        count, repeated = _count(bpe, own), _count(bpe, again)
        wrong = set(doc[(count > limit) | (repeated > overlap)].tolist())
        bounds = np.searchsorted(doc, np.arange(len(todo) + 1))
        for d, i in enumerate(todo):
            if d not in wrong:
                a, b = bounds[d], bounds[d + 1]
                yield i, list(zip(start[a:b].tolist(), end[a:b].tolist(), count[a:b].tolist(), repeated[a:b].tolist(), kind[a:b].tolist()))
        todo, spare = [todo[d] for d in sorted(wrong)], spare + 8


def _count(bpe, texts: list[str]) -> np.ndarray:
    """Tokens of each text by itself."""
    words = [bpe.split.findall(t) if t else [] for t in texts]
    sizes = np.concatenate([[0], np.cumsum(bpe.token_counts(bpe.word_numbers(w for ws in words for w in ws)))])
    stops = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)
    return np.diff(sizes[stops])


def split_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, overlap: int = 64, vocabulary: str | None = None) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens: ``id_col``, ``piece INT`` (from 0), ``start INT`` and ``end INT`` (code
    points), ``n_tokens INT`` (of the piece by itself), ``overlap_tokens INT``, ``ends_at STRING`` and ``piece_text STRING``.

    Pieces have at most ``limit`` tokens, each but the first begins with up to the last ``overlap`` tokens of the one before;
    without these repeats they are the whole text.  A piece ends at the last heading, paragraph, line or sentence end in
    reach, else at the last word, and inside an unbroken stretch only if nothing else is in reach, between characters.

    Method: for every boundary the farthest legal successor, its own overlap included, comes from one sorted search over the
    running token counts of all texts of a block; then pointer doubling squares the successor table (``jump[jump]``), so
    that all cuts of all texts are derived in as many rounds as the logarithm of the most pieces, not one after another.
    Exact token counts of the pieces follow; a text with a piece over the limit (white space encodes otherwise at a seam)
    is cut again with more tokens spared.  No shuffle: a text is cut where it is read.

    Null, empty, blank and short texts give no rows.  A repeated row gives its pieces again.  Other columns aren't read.
    """
    path = vocabulary or tokenizer_path()
    if limit < 4 * INSIDE or not 0 <= overlap <= limit // 2:
        raise ValueError(f"the limit must be at least {4 * INSIDE}, the overlap at most half of the limit")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lorespan.llm.trie_bpe import encoder

        bpe = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, words, numbers in bpe.blocks(texts):
                stops = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                tokens = np.concatenate([[0], np.cumsum(bpe.token_counts(numbers))])[stops]
                long_ = np.flatnonzero(np.diff(tokens) > limit).tolist()
                rows: list[tuple] = []
                own = [texts[at + i] for i in long_]
                for k, pieces in _pieces(bpe, own, [words[i] for i in long_], [numbers[stops[i] : stops[i + 1]] for i in long_], limit, overlap):
                    rows += [(at + long_[k], n, a, b, count, again, KINDS[kind], own[k][a:b]) for n, (a, b, count, again, kind) in enumerate(pieces)]
                if rows:
                    key, *rest = zip(*rows)
                    arrays = [pa.array(c, t) for c, t in zip(rest, [pa.int32()] * 5 + [pa.string()] * 2)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(key, pa.int32())), *arrays], names=["key", "piece", "start", "end", "n_tokens", "overlap_tokens", "ends_at", "piece_text"])

    wanted = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text"))
    kind = wanted.schema["key"].dataType.simpleString()
    pieces = wanted.mapInArrow(split, f"key {kind}, piece int, start int, end int, n_tokens int, overlap_tokens int, ends_at string, piece_text string")
    return pieces.withColumnRenamed("key", id_col)


def rebuilt_texts(docs: DataFrame, pieces: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, overlap: int = 64) -> DataFrame:
    """``id_col``, ``digest`` of every text that is not null, of a split one put together from its pieces without their repeats, and
    whether the pieces ``fit`` the limit and the overlap, and ``follow`` each other without a gap.  Ids are unique."""
    before = F.lag("end", 1, 0).over(W.partitionBy(id_col).orderBy("piece"))
    placed = pieces.withColumn("before", before)
    fits = (F.col("n_tokens") <= limit) & (F.col("overlap_tokens") <= overlap)
    follows = (F.col("start") <= F.col("before")) & (F.col("before") < F.col("end"))
    new = F.expr("substring(piece_text, before - start + 1)")
    whole = placed.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_list(F.struct("piece", new.alias("new"))))["new"], "").alias("rebuilt"), F.every(fits).alias("fit"), F.every(follows).alias("follow"))
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("text"))
    true = F.lit(True)
    return texts.join(whole, id_col, "left").select(id_col, F.sha2(F.coalesce("rebuilt", "text"), 256).alias("digest"), F.coalesce("fit", true).alias("fit"), F.coalesce("follow", true).alias("follow"))
