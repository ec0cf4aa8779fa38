"""Claims and the pages and sources that bear them: evidence of search results, orphans, snippets, rewrites of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.functions import text as T

#: What a claim's status adds to its score as evidence, and the weight of its confidence.
STATUS_WEIGHTS = {"ok": 0.2, "needs-review": 0.0, "stale": -0.12, "contradicted": -0.22}
OTHER_STATUS, CONFIDENCE_WEIGHT = -0.25, 0.35

#: Most characters of a snippet, step of the windows of a longer one, and the least share of a claim's words in it.
SNIPPET, STEP, LEAST_SHARE = 420, 315, 0.34

#: Fixed value: where a sentence ends, for snippets.
SENTENCE = r"([.!?。！？；;])\s+"

#: Separates windows while they are packed.
RECORD = "\x1e"


def comparable_path(path: Column) -> Column:
    """A page's path from its ``wiki/`` folder on, with forward slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(?s)\A.*?/(wiki/)", "$1")


def reference_form(name: Column) -> Column:
    """A name without case, white space, hyphens and underscores, as merged pages' names are compared."""
    return F.regexp_replace(F.lower(name), r"[ \t\r\n\-_]+", "")


def claim_evidence(claims: DataFrame, results: DataFrame, terms: list[str], most: int = 10) -> DataFrame:
    """The best claims of the pages of a search: ``claim_id``, ``path``, ``score``, ``matched`` (query words that the claim holds).

    ``claims`` has ``claim_id``, ``path``, ``text``, ``confidence``, ``status``; ``results`` has ``path`` and ``place``, the few results of a
    search, and each path once.  A score is 1 / place, the share of the query's words, and shares for confidence and status.
    """
    weights = F.create_map(*(F.lit(x) for pair in STATUS_WEIGHTS.items() for x in pair))
    own = claims.join(F.broadcast(results), "path")  # a search has a bounded number of results
    matched = F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower("text"), t))
    score = (
        F.lit(1.0) / F.greatest(F.lit(1), "place") + F.size(matched) / F.lit(len(terms)) + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))) * F.lit(CONFIDENCE_WEIGHT)
        + F.coalesce(F.try_element_at(weights, F.col("status")), F.lit(OTHER_STATUS))
    )
    return own.select("claim_id", "path", F.round(score, 6).alias("score"), F.array_join(matched, " ").alias("matched")).orderBy(F.desc("score"), "claim_id").limit(most)


def comparable_text(text: Column) -> Column:
    """Lower-cased words of a text joined by single blanks, without marks of Markdown and punctuation but hyphens."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\-]+", " ")
    return F.btrim(plain, F.lit(" "))


def overlap_tokens(comparable: Column) -> Column:
    """Distinct words of ASCII letters, digits and hyphens of two or more characters, and pairs of Chinese characters."""
    words = F.regexp_extract_all(comparable, F.lit(r"([a-z0-9][a-z0-9-]+)"), F.lit(1))
    han = F.regexp_extract_all(comparable, F.lit(r"([\x{3400}-\x{9fff}])"), F.lit(1))
    pairs = F.when(F.size(han) > 1, F.zip_with(F.slice(han, 1, F.size(han) - 1), F.slice(han, 2, F.size(han) - 1), lambda a, b: F.concat(a, b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def snippets(text: Column, most: int = SNIPPET, step: int = STEP) -> Column:
    """The snippets of a text: its paragraphs; of longer ones, windows of whole sentences; of longer sentences, overlapping windows."""
    trim = lambda x: F.btrim(x, F.lit(" \t\r\n"))
    filled = lambda xs: F.filter(F.transform(xs, trim), lambda x: x != "")
    blocks = filled(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"\n{2,}"))

    def packed(block: Column) -> Column:
        sentences = filled(F.split(F.regexp_replace(block, SENTENCE, "$1\n"), r"\n+"))
        fits = lambda done, s: F.length(F.substring_index(done, RECORD, -1)) + 1 + F.length(s) <= most
        joined = F.aggregate(sentences, F.lit(""), lambda done, s: F.when(done == "", s).when(fits(done, s), F.concat(done, F.lit(" "), s)).otherwise(F.concat(done, F.lit(RECORD), s)))
        return F.flatten(F.transform(F.split(joined, RECORD), cut))

    def cut(window: Column) -> Column:
        starts = F.sequence(F.lit(0), F.length(window) - 1, F.lit(step))
        return F.when(F.length(window) <= most, F.array(window)).otherwise(filled(F.transform(starts, lambda i: F.substring(window, i + 1, F.lit(most)))))

    return F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) <= most, F.array(b)).otherwise(packed(b))))


def snippet_provenance(claims: DataFrame, sources: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Where a source of a claim's page states it: ``claim_id``, ``doc_id``, ``place``, ``score``, ``snippet``.

    ``claims`` has ``claim_id``, ``path``, ``text``; ``sources`` has ``doc_id``, ``path``, ``text``.  The first snippet that holds the claim's
    words as they stand scores 1; else the one that has the greatest share of them, at least ``least`` and three words.  Null
    and blank texts, and claims without words, have none.
    """
    cut = sources.select("path", "doc_id", F.posexplode(snippets(F.col("text"))).alias("place", "snippet")).withColumn("plain", comparable_text(F.col("snippet")))
    cut = cut.withColumn("have", overlap_tokens(F.col("plain")))
    asked = claims.select("claim_id", "path", comparable_text(F.col("text")).alias("claim")).where("claim <> ''").withColumn("want", overlap_tokens(F.col("claim")))
    shared = F.size(F.array_intersect("want", "have"))
    share = shared / F.greatest(F.size("want"), F.lit(1))
    score = F.when(F.contains("plain", F.col("claim")), F.lit(1.0)).when((shared >= F.least(F.lit(3), F.size("want"))) & (F.size("want") > 0) & (share >= least), share)
    hits = asked.join(cut, "path").withColumn("score", F.round(score, 6)).where("score is not null")
    found = hits.withColumn("holds", F.contains("plain", F.col("claim")))
    first = F.struct((~F.col("holds")).alias("later"), (-F.col("score")).alias("less"), "doc_id", "place")
    return found.groupBy("claim_id").agg(F.min_by(F.struct("doc_id", "place", "score", "snippet"), first).alias("s")).select("claim_id", "s.*")


def redirects(requests: DataFrame) -> DataFrame:
    """``form``, ``canonical``: to which page each name of a merged page leads: its slug, its title and its aliases; of several the smallest."""
    pages = requests.where("canonical_slug is not null").select("canonical_slug", F.explode("merge_group").alias("p")).where(F.col("p.slug").isNotNull() & (F.col("p.slug") != F.col("canonical_slug")))
    front = T.front_matter(F.coalesce("p.content", F.lit("")))
    names = F.concat(F.array("p.slug"), T.front_entries(front, "title", "alias", "aliases"))
    forms = pages.select(F.col("canonical_slug").alias("canonical"), F.explode(names).alias("name")).select(reference_form(F.col("name")).alias("form"), "canonical").where("form <> ''")
    return forms.groupBy("form").agg(F.min("canonical").alias("canonical"))


def reference_rewrites(docs: DataFrame, leads: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``target``, ``canonical``, ``times``: links of texts to merged pages, and the page that they lead to now."""
    links = docs.select(id_col, F.explode(T.wikilinks(F.col("text"))).alias("target")).groupBy(id_col, "target").agg(F.count("*").alias("times"))
    found = links.withColumn("form", reference_form(F.col("target"))).join(leads, "form")
    return found.where("target <> canonical").select(id_col, "target", "canonical", "times")


def expanded(hits: DataFrame, related: DataFrame, least: float = 2.0) -> DataFrame:
    """Pages that a search didn't find but that are related to its results: ``id``, ``relevance`` to the first result that names it.

    ``hits`` has ``id`` and ``place``, the few results of a search; ``related`` has ``id``, ``other``, ``relevance``.
    """
    few = F.broadcast(hits)  # a search has a bounded number of results
    near = related.where(F.col("relevance") >= least).select("id", "other", "relevance").join(few, "id").join(F.broadcast(hits.select(F.col("id").alias("other"))), "other", "left_anti")
    return near.groupBy(F.col("other").alias("id")).agg(F.min_by("relevance", F.struct("place", "id")).alias("relevance"))
