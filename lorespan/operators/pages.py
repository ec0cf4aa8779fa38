"""What pages hold besides prose: anchors of claims, reviews, chunks for embedding, an index cut to a budget; candidates for unresolved names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: a line that anchors a claim.
ANCHOR = r"^[ \t]*<!-- claim:([A-Za-z0-9][A-Za-z0-9_-]*) -->[ \t]*$"

#: A review with its kind, title and body, and its kinds; others are ``confirm``.
REVIEW = r"---REVIEW:[ \t\r\n]*([A-Za-z0-9_][A-Za-z0-9_-]*)[ \t\r\n]*\|[ \t\r\n]*([^\n]+?)[ \t\r\n]*---\n((?s:.*?))---END REVIEW---"
REVIEW_KINDS = ("contradiction", "duplicate", "missing-page", "suggestion")

BLANK = " \t\r\n"

#: Lengths of a key's head: the first of these that the key has.
HEADS = (8, 4, 3, 2, 1)


def claim_anchors(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``line`` (from 1), ``claim_id``, ``claim``: each anchor of a claim, and the first line of text behind it, without a list's mark.

    Without any such line the claim is empty.
    """
    lines = F.transform(F.split("text", r"\r?\n"), lambda x: F.btrim(F.regexp_replace(x, r"^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+", ""), F.lit(" \t")))
    raw = F.transform(F.split("text", r"\r?\n"), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, ANCHOR, 1).alias("claim_id")))
    found = docs.where(F.contains("text", F.lit("<!-- claim:"))).select(id_col, lines.alias("lines"), F.explode(F.filter(raw, lambda x: x["claim_id"] != "")).alias("a"))
    rest = F.filter(F.slice("lines", F.col("a.line") + 1, F.size("lines")), lambda x: (x != "") & ~x.startswith("<!--"))
    return found.select(id_col, "a.line", "a.claim_id", F.coalesce(F.get(rest, F.lit(0)), F.lit("")).alias("claim"))


def reviews(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``place``, ``kind``, ``title``, ``options``, ``pages``, ``searches`` (arrays) and ``description`` of each review; a review without options has Approve and Skip."""
    part = lambda i: F.regexp_extract_all("text", F.lit(REVIEW), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("kind"), part(2).alias("title"), part(3).alias("body"))
    rows = docs.where(F.contains("text", F.lit("---REVIEW:"))).select(id_col, F.posexplode(zipped).alias("place", "r"))
    trim = lambda x: F.btrim(x, F.lit(BLANK))
    line = lambda key: F.regexp_extract("r.body", rf"(?:\A|\n){key}:[ \t]*([^\n]+)", 1)
    split = lambda key, by: F.filter(F.transform(F.split(line(key), by), trim), lambda x: x != "")
    kind = F.lower("r.kind")
    options = split("OPTIONS", r"\|")
    plain = F.regexp_replace("r.body", r"(?:\A|\n)(?:OPTIONS|PAGES|SEARCH):[^\n]*", "")
    return rows.select(
        id_col, "place", F.when(kind.isin(*REVIEW_KINDS), kind).otherwise("confirm").alias("kind"), trim("r.title").alias("title"),
        F.when(F.size(options) == 0, F.array(F.lit("Approve"), F.lit("Skip"))).otherwise(options).alias("options"), split("PAGES", ",").alias("pages"), split("SEARCH", r"\|").alias("searches"), trim(plain).alias("description"),
    )


def embedding_texts(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """``chunk_id``, ``content``: a chunk's text behind its page's title and its headings, as it is embedded; blank ones are left out.

    ``chunks`` has ``chunk_id``, ``page_id``, ``heading_path``, ``chunk_text``; ``titles`` has ``page_id``, each once, and ``title``.
    """
    trimmed = lambda c: F.nullif(F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANK)), F.lit(""))
    return chunks.join(titles, "page_id", "left").select("chunk_id", F.concat_ws("\n\n", trimmed(F.col("title")), trimmed(F.col("heading_path")), trimmed(F.col("chunk_text"))).alias("content"))


def trimmed_index(text: Column, words: list[str], budget: int) -> Column:
    """The lines of an index that head a section or hold a word of the query, as many as fit the budget; a line that doesn't fit is skipped."""
    lines = F.filter(F.split(text, r"\n"), lambda x: x.startswith("##") | F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(x), w)))
    kept = F.aggregate(lines, F.lit(""), lambda done, x: F.when(F.length(done) + F.length(x) + 1 <= budget, F.concat(done, x, F.lit("\n"))).otherwise(done))
    return F.when(F.length(text) <= budget, text).otherwise(F.regexp_replace(kept, r"\n\z", ""))


def _head(key: Column) -> Column:
    return F.coalesce(*(F.when(F.length(key) >= n, F.substring(key, 1, n)) for n in HEADS))


def likely_parts(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The columns of ``texts`` but ``text``, and ``part``: all parts of the text that are keys of its project, and others that begin like a key and are as long.

    ``texts`` has ``project_id``, ``text`` and what else is wanted; ``keys`` has ``project_id``, ``key``.  Spark takes what is exploded
    for as large as the texts are and would broadcast it, so the hint names the side that isn't: it is built by partitions.
    """
    own = [c for c in texts.columns if c != "text"]
    sizes = keys.agg(F.collect_set(F.length(_head(F.col("key")))).alias("sizes"), F.max(F.length("key")).alias("longest"))  # one row
    heads = keys.groupBy("project_id", _head(F.col("key")).alias("head")).agg(F.collect_set(F.length("key")).alias("lengths"))
    n = F.length("text")
    rest = lambda i, size: F.substring("text", i, F.when(size == HEADS[0], F.col("longest")).otherwise(F.lit(HEADS[0] - 1))).alias("rest")
    places = lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.struct(F.substring("text", i, size).alias("head"), rest(i, size)))
    cut = texts.crossJoin(F.broadcast(sizes)).select(*own, F.explode(F.flatten(F.transform(F.filter("sizes", lambda size: size <= n), places))).alias("at")).select(*own, "at.*")
    found = cut.join(heads.hint("shuffle_hash"), ["project_id", "head"])
    return found.select(*own, F.explode(F.transform(F.filter("lengths", lambda x: x <= F.length("rest")), lambda x: F.substring("rest", F.lit(1), x))).alias("part"))


def name_candidates(names: DataFrame, keys: DataFrame, shortest: int = 1) -> DataFrame:
    """``project_id``, ``name``, ``candidate``: for each unresolved name the first page (by id) of which a key holds the name, or is held by it.

    ``names`` has ``project_id``, ``name``, each once; ``keys`` has ``project_id``, ``key``, ``id``.  Instead of comparing all names with
    all keys, the parts of each that begin like one of the other are joined with the other as a whole.
    """
    first = keys.where(F.length("key") >= shortest).groupBy("project_id", "key").agg(F.min("id").alias("id"))
    held = likely_parts(first.select("project_id", F.col("key").alias("text"), "id"), names.select("project_id", F.col("name").alias("key")))
    held = held.groupBy("project_id", F.col("part").alias("name")).agg(F.min("id").alias("id"))  # pre-aggregated before the join
    wide = held.join(names.select("project_id", "name").hint("shuffle_hash"), ["project_id", "name"]).select("project_id", "name", "id")
    narrow = likely_parts(names.select("project_id", F.col("name").alias("text"), "name"), first).withColumnRenamed("part", "key")
    narrow = narrow.join(first.hint("shuffle_hash"), ["project_id", "key"]).select("project_id", "name", "id")
    return wide.unionByName(narrow).groupBy("project_id", "name").agg(F.min("id").alias("candidate"))
