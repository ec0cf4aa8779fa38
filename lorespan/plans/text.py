"""Queries over the texts of documents: words, titles, links, snippets, redaction, ids, front matter, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions import text as T
from lorespan.functions.links import reference_key
from lorespan.session import table

PHRASE = "index"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", spread=True).where("text is not null")


def token_frequency(spark: SparkSession, folder: str) -> DataFrame:
    words = T.token_rows(documents(spark, folder).select("doc_id", "text"), "text")
    each = words.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return each.groupBy("token").agg(F.sum("n").alias("occurrences"), F.count("*").alias("docs"))


def page_titles(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", T.page_title(F.col("text"), F.col("page_path")).alias("title"))


def snippets(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", T.snippet(F.col("text"), PHRASE).alias("snippet"))


def phrase_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", T.occurrences(F.lower("text"), PHRASE).alias("occurrences")).where("occurrences > 0")


def document_links(spark: SparkSession, folder: str) -> DataFrame:
    links = documents(spark, folder).select("doc_id", F.explode(T.wikilinks(F.col("text"))).alias("link"))
    return links.groupBy("doc_id", "link").agg(F.count("*").alias("times"))


def image_refs(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.posexplode(T.image_urls(F.col("text"))).alias("place", "url"))


def redacted_documents(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", T.redacted(F.col("text")).alias("safe")).where(F.contains("safe", F.lit("[REDACTED")))


def title_slugs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "entity_summaries").where("title is not null").select("summary_id", T.slug(F.col("title")).alias("name")).distinct()


def fnv_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entity_summaries")
    names = rows.select(F.explode(F.array("slug", "title")).alias("name")).where("name is not null").distinct()
    return names.select("name", T.fnv36(F.col("name")).alias("id"))


def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    hashed = documents(spark, folder).select("doc_id", F.sha2("text", 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


def script_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).select("lang", T.script_counts(F.col("text")).alias("c"), T.main_script(F.col("text")).alias("script"))
    sums = [F.sum(f"c.{s}").cast("long").alias(s) for s in ("han", "kana", "hangul", "arabic", "cyrillic", "devanagari", "latin")]
    return rows.groupBy("lang", "script").agg(F.count("*").alias("docs"), *sums)


def language_check(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by given and by detected language."""
    return documents(spark, folder).groupBy("lang", T.language(F.col("text")).alias("detected")).agg(F.count("*").alias("docs"))


def network_links(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "retrieval_nodes").select("row_id", F.explode("out_links").alias("link")).where(F.contains("link", F.lit("://")))
    return links.distinct().groupBy(T.network_kind(F.col("link")).alias("kind")).agg(F.count("*").alias("links"), F.countDistinct("link").alias("addresses"))


def claim_lines(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", F.posexplode(T.sentences_with_signal(F.col("text"))).alias("place", "claim"))


def front_matter_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of front matters: how many documents have each, its entries, and how often it is a list of several."""
    fields = documents(spark, folder).select("doc_id", F.explode(T.front_matter(F.col("text"))).alias("f")).select("doc_id", F.lower("f.field").alias("field"), F.size("f.entries").alias("n"))
    return fields.groupBy("field").agg(F.countDistinct("doc_id").alias("docs"), F.sum("n").alias("entries"), F.count_if(F.col("n") > 1).alias("lists"))


def front_matter_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry of every field of the front matters, in order."""
    fields = documents(spark, folder).select("doc_id", F.posexplode(T.front_matter(F.col("text"))).alias("line", "f"))
    return fields.select("doc_id", "line", "f.field", F.posexplode("f.entries").alias("place", "value"))


def page_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Five dimensions of a page from 0 to 1, weighted: structure, citation, relation, retrieval, governance."""
    t = F.col("text")
    has = lambda pattern: t.rlike(pattern).cast("int")
    dims = documents(spark, folder).select(
        "doc_id",
        F.round((has(r"(?:\A|\n)# ") + has(r"(?:\A|\n)## ") + (F.length(t) >= 200).cast("int") + has(r"\A---\n")) / F.lit(4.0), 2).alias("structure"),
        F.round(has(r"\nsources:[ \t]*\[[^\]\n]") * F.lit(1.0), 2).alias("citation"),
        F.round(F.least(F.size(T.wikilinks(t)), F.lit(5)) / F.lit(5.0), 2).alias("relation"),
        F.round((has(r"\ntitle:[ \t]*[^ \n]") + has(r"\ntags:[ \t]*\[[^\]\n]")) / F.lit(2.0), 2).alias("retrieval"),
        F.round((has(r"\nupdated:[ \t]*[0-9]{4}-[0-9]{2}-[0-9]{2}") + has(r"\ntype:[ \t]*[^ \n]")) / F.lit(2.0), 2).alias("governance"),
    )
    score = F.col("structure") * 25 + F.col("citation") * 25 + F.col("relation") * 20 + F.col("retrieval") * 15 + F.col("governance") * 15
    return dims.withColumn("score", F.round(score / 100, 4))


def slides(spark: SparkSession, folder: str) -> DataFrame:
    """Pages cut into slides at second-level headings."""
    body = T.page_body(F.col("text"))
    parts = F.split(F.concat(F.lit("\n"), body), r"\n## ")
    return documents(spark, folder).where(F.contains("text", F.lit("\n## "))).select("doc_id", F.posexplode(parts).alias("slide", "content")).select("doc_id", "slide", F.length("content").alias("n_chars"))


def table_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of pipe tables of a page; a page is a table if it has three or more and they are more than 60 % of its lines."""
    lines = F.filter(F.split("text", r"\n"), lambda x: F.trim(x) != "")
    rows = F.filter(lines, lambda x: F.trim(x).startswith("|") & F.trim(x).endswith("|"))
    found = documents(spark, folder).select("doc_id", F.size(rows).alias("table_lines"), F.size(lines).alias("all_lines"))
    return found.where("table_lines > 0").withColumn("is_table", (F.col("table_lines") >= 3) & (F.col("table_lines") > F.col("all_lines") * F.lit(0.6)))


def link_keys(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "retrieval_nodes").select(F.explode("out_links").alias("link"))
    return links.groupBy(reference_key(F.col("link")).alias("target")).agg(F.count("*").alias("times"), F.countDistinct("link").alias("spellings")).where("target is not null")


QUERIES = {f.__name__: f for f in (token_frequency, page_titles, snippets, phrase_occurrences, document_links, image_refs, redacted_documents, title_slugs, fnv_ids, content_hash, script_counts, language_check, network_links, claim_lines, front_matter_fields, front_matter_values, page_quality, slides, table_exports, link_keys)}

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_BREAK = T.CORPUS_BREAK.replace("''", "''''")


def sql_tokens(text: str, breaks: str = _BREAK) -> str:
    """The list of words of a text, for DuckDB."""
    return rf"""flatten(list_transform(list_filter(regexp_split_to_array(lower({text}), '{breaks}'), lambda x: length(x) > 1 AND NOT list_contains({_STOP}, x)),
  lambda t: CASE WHEN regexp_matches(t, '{T.HAN}') AND length(t) > 2 THEN
    list_transform(generate_series(1, length(t) - 1), lambda i: substring(t, i, 2)) || list_filter(list_transform(generate_series(1, length(t)), lambda i: substring(t, i, 1)), lambda c: NOT list_contains({_STOP}, c)) || [t]
  ELSE [t] END))"""


_D = "(SELECT * FROM documents WHERE text IS NOT NULL)"
_TITLE = r"""coalesce(nullif(trim(regexp_extract(text, '\A---\n(?:(?s:.)*?\n)?title:[ \t]*["'']?([^\n]+?)["'']?[ \t]*(?:\n|\z)', 1), ' '), ''),
  nullif(trim(regexp_extract(text, '(?:\A|\n)#[ \t]+([^\n]+)', 1), ' '), ''), replace(regexp_replace(regexp_replace(page_path, '^.*/', ''), '\.md$', ''), '-', ' '))"""
_COUNT = lambda cls: f"sum(length(text) - length(regexp_replace(text, '{cls}', '', 'g')))::BIGINT"
_N = lambda cls: f"(length(text) - length(regexp_replace(text, '{cls}', '', 'g')))"
_CLASSES = {"han": r"\p{Han}", "kana": r"[\x{3040}-\x{30ff}]", "hangul": r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}]", "arabic": r"[\x{600}-\x{6ff}]", "cyrillic": r"[\x{400}-\x{4ff}]", "devanagari": r"[\x{900}-\x{97f}]", "latin": r"[A-Za-z\x{c0}-\x{24f}]"}
_OTHERS = {"hangul": _CLASSES["hangul"], "arabic": _CLASSES["arabic"], "cyrillic": _CLASSES["cyrillic"], "devanagari": _CLASSES["devanagari"], "thai": r"[\x{e00}-\x{e7f}]", "hebrew": r"[\x{590}-\x{5ff}]", "greek": r"[\x{370}-\x{3ff}]"}
_KEY = r"""CASE WHEN {0} NOT LIKE '%://%' THEN nullif(trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(regexp_replace(
  regexp_replace(trim({0}, ' '), '^\[\[(.*)\]\]$', '\1', 's'), '[|#].*', '', 's'), ' '), '^.*/', '', 's')), '\.md$', ''), '[ _-]+', '-', 'g'), '-'), '') END"""



def _safe(text: str) -> str:
    for pattern, safe in T.SECRETS:
        text = f"""regexp_replace({text}, '{pattern.replace("'", "''")}', '{safe.replace("$1", chr(92) + "1")}', 'g')"""
    return text


_blank = "' ' || chr(9) || chr(13)"
sql_bare = lambda x: rf"""trim(regexp_replace(trim({x}, {_blank}), '(?s)\A(?:"(.*)"|''(.*)'')\z', '\1\2'), {_blank})"""
_list = lambda x: f"list_transform(string_split({x}, ','), lambda e: {sql_bare('e')})"
_part = lambda i: f"regexp_extract_all(regexp_extract(text, '{T.FRONT}', 1), '{T.ENTRY}', {i})"
_BODY = f"regexp_replace(text, '{T.FRONT}', '')"
#: fm: the fields of every document's front matter, with their entries.
_FRONT = rf"""fz AS (SELECT doc_id, field, value, items, pos AS line FROM (SELECT doc_id, unnest(f) AS field, unnest(v) AS value, unnest(i) AS items, unnest(generate_series(1, len(f))) AS pos
  FROM (SELECT doc_id, {_part(1)} AS f, {_part(2)} AS v, {_part(3)} AS i FROM {_D}))),
fm AS (SELECT doc_id, line, field, list_filter(CASE WHEN v = '' THEN list_transform(regexp_extract_all(items, '-([^\n]*)', 1), lambda e: {sql_bare('e')}) WHEN regexp_matches(v, '{T.BARE_LINKS}') THEN {_list('v')}
  WHEN v LIKE '[%]' AND v NOT LIKE '[[%' THEN {_list('v[2:-2]')} ELSE [{sql_bare('v')}] END, lambda e: e <> '') AS entries FROM (SELECT *, trim(value, {_blank}) AS v FROM fz))"""

SQL = {
    "token_frequency": f"SELECT token, sum(n)::BIGINT AS occurrences, count(*) AS docs FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS token FROM {_D}) GROUP BY ALL) GROUP BY token",
    "page_titles": f"SELECT doc_id, {_TITLE} AS title FROM {_D}",
    "snippets": f"""SELECT doc_id, CASE WHEN pos = 0 THEN replace(substring(text, 1, 160), chr(10), ' ') ELSE
  CASE WHEN s > 0 THEN '...' ELSE '' END || replace(substring(text, s + 1, e - s), chr(10), ' ') || CASE WHEN e < length(text) THEN '...' ELSE '' END END AS snippet
  FROM (SELECT *, greatest(pos - 1 - 80, 0) AS s, least(pos - 1 + {len(PHRASE)} + 80, length(text)) AS e FROM (SELECT *, instr(lower(text), '{PHRASE}') AS pos FROM {_D}))""",
    "phrase_occurrences": f"SELECT * FROM (SELECT doc_id, ((length(text) - length(replace(lower(text), '{PHRASE}', ''))) // {len(PHRASE)})::INT AS occurrences FROM {_D} WHERE length(lower(text)) = length(text)) WHERE occurrences > 0",
    "document_links": rf"SELECT doc_id, link, count(*) AS times FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)), ' ') AS link FROM {_D}) GROUP BY ALL",
    "image_refs": rf"SELECT doc_id, (pos - 1)::INT AS place, urls[pos] AS url FROM (SELECT doc_id, list_distinct_keep AS urls, unnest(generate_series(1, len(list_distinct_keep))) AS pos FROM (SELECT doc_id, list_filter(u, lambda x, i: list_position(u, x) = i) AS list_distinct_keep FROM (SELECT doc_id, regexp_extract_all(text, '!\[[^\]]*\]\(([^)\s]+)\)', 1) AS u FROM {_D})))",
    "redacted_documents": f"SELECT * FROM (SELECT doc_id, {_safe('text')} AS safe FROM {_D}) WHERE contains(safe, '[REDACTED')",
    "title_slugs": r"""SELECT DISTINCT summary_id, coalesce(nullif(trim(substring(regexp_replace(trim(regexp_replace(regexp_replace(lower(title), '[\s]+', '-', 'g'), '[^\p{L}\p{N}\-]+', '', 'g'), '-'), '-+', '-', 'g'), 1, 50), '-'), ''), 'query') AS name FROM entity_summaries WHERE title IS NOT NULL""",
    "fnv_ids": """WITH h AS (SELECT name, list_reduce([2166136261::BIGINT] || list_transform(generate_series(1, length(name)), lambda i: ascii(substring(name, i, 1))::BIGINT), lambda h, b: (xor(h, b) * 16777619) & 4294967295) AS v
  FROM (SELECT slug AS name FROM entity_summaries WHERE slug IS NOT NULL UNION SELECT title FROM entity_summaries WHERE title IS NOT NULL))
SELECT name, coalesce(nullif(ltrim(list_aggregate(list_transform(range(6, -1, -1), lambda e: substring('0123456789abcdefghijklmnopqrstuvwxyz', ((v // (36::BIGINT ** e)::BIGINT) % 36)::INT + 1, 1)), 'string_agg', ''), '0'), ''), '0') AS id FROM h""",
    "content_hash": f"SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_doc FROM {_D} GROUP BY text HAVING count(*) > 1",
    "script_counts": f"""SELECT lang, script, count(*) AS docs, {', '.join(f'sum({k})::BIGINT AS {k}' for k in _CLASSES)} FROM (SELECT lang, {', '.join(f'{k}' for k in _CLASSES)},
  CASE WHEN kana > 0 AND kana + han >= 2 THEN 'Japanese' WHEN most < 2 THEN 'Latin' WHEN han = most THEN 'Chinese' {' '.join(f"WHEN {k} = most THEN '{k.capitalize()}'" for k in _OTHERS)} END AS script
  FROM (SELECT *, greatest({', '.join(_OTHERS)}, han) AS most FROM (SELECT lang, {', '.join(f'{_N(c)} AS {k}' for k, c in (_CLASSES | _OTHERS).items())} FROM {_D}))) GROUP BY ALL""",
    "language_check": f"""SELECT lang, CASE WHEN script = 'Latin' THEN CASE {' '.join(f"WHEN {n} = greatest({', '.join(T.FUNCTION_WORDS)}) THEN '{n}'" for n in T.FUNCTION_WORDS)} END ELSE lower(script) END AS detected, count(*) AS docs FROM (SELECT lang, {', '.join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(o) for o in own)}))) AS {n}" for n, own in T.FUNCTION_WORDS.items())},
  CASE WHEN kana > 0 AND kana + han >= 2 THEN 'Japanese' WHEN most < 2 THEN 'Latin' WHEN han = most THEN 'Chinese' {' '.join(f"WHEN {k} = most THEN '{k.capitalize()}'" for k in _OTHERS)} END AS script
  FROM (SELECT *, greatest({', '.join(_OTHERS)}, han) AS most FROM (SELECT lang, regexp_extract_all(lower(text), '\\p{{L}}+') AS w, {', '.join(f'{_N(c)} AS {k}' for k, c in (_CLASSES | _OTHERS).items())} FROM {_D}))) GROUP BY ALL""",
    "network_links": r"""SELECT kind, count(*) AS links, count(DISTINCT link) AS addresses FROM (SELECT link, CASE WHEN host = '' THEN 'invalid' WHEN regexp_matches(host, '^(localhost|127\.[0-9.]+|::1)$') THEN 'loopback'
  WHEN regexp_matches(host, '^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.)|\.local$|^[^.]+$') THEN 'lan' ELSE 'public' END AS kind
  FROM (SELECT *, lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM (SELECT DISTINCT row_id, link FROM (SELECT row_id, unnest(out_links) AS link FROM retrieval_nodes) WHERE link LIKE '%://%'))) GROUP BY kind""",
    "claim_lines": rf"""SELECT doc_id, (pos - 1)::INT AS place, c[pos] AS claim FROM (SELECT doc_id, c, unnest(generate_series(1, least(len(c), 8))) AS pos FROM (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS c FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '^[ \t]*(?:[-*+]|[0-9]+\.)[ \t]+', ''), ' ')), lambda x: length(x) >= 32 AND regexp_matches(lower(x), '(decid|because|therefore|should|must|lesson|conclu|confirm|结论|决定|因为|应该|必须)')) AS l FROM {_D})))""",
    "front_matter_fields": f"WITH {_FRONT} SELECT lower(field) AS field, count(DISTINCT doc_id) AS docs, sum(len(entries))::BIGINT AS entries, count(*) FILTER (WHERE len(entries) > 1) AS lists FROM fm GROUP BY 1",
    "front_matter_values": f"WITH {_FRONT} SELECT doc_id, (line - 1)::INT AS line, field, (pos - 1)::INT AS place, entries[pos] AS value FROM (SELECT *, unnest(generate_series(1, len(entries))) AS pos FROM fm)",
    "page_quality": rf"""SELECT *, round((structure * 25 + citation * 25 + relation * 20 + retrieval * 15 + governance * 15) / 100, 4) AS score FROM (SELECT doc_id,
  round((regexp_matches(text, '(?:\A|\n)# ')::INT + regexp_matches(text, '(?:\A|\n)## ')::INT + (length(text) >= 200)::INT + regexp_matches(text, '\A---\n')::INT) / 4.0::DOUBLE, 2) AS structure,
  round(regexp_matches(text, '\nsources:[ \t]*\[[^\]\n]')::INT * 1.0::DOUBLE, 2) AS citation, round(least(len(regexp_extract_all(text, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)), 5) / 5.0::DOUBLE, 2) AS relation,
  round((regexp_matches(text, '\ntitle:[ \t]*[^ \n]')::INT + regexp_matches(text, '\ntags:[ \t]*\[[^\]\n]')::INT) / 2.0::DOUBLE, 2) AS retrieval,
  round((regexp_matches(text, '\nupdated:[ \t]*[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')::INT + regexp_matches(text, '\ntype:[ \t]*[^ \n]')::INT) / 2.0::DOUBLE, 2) AS governance FROM {_D})""",
    "slides": f"SELECT doc_id, (pos - 1)::INT AS slide, length(p[pos])::INT AS n_chars FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS pos FROM (SELECT doc_id, string_split(chr(10) || regexp_replace(text, '{T.FRONT}', ''), chr(10) || '## ') AS p FROM {_D} WHERE contains(text, chr(10) || '## ')))",
    "table_exports": rf"""SELECT *, table_lines >= 3 AND table_lines > all_lines * 0.6 AS is_table FROM (SELECT doc_id, len(list_filter(l, lambda x: trim(x, ' ') LIKE '|%' AND trim(x, ' ') LIKE '%|'))::INT AS table_lines, len(l)::INT AS all_lines
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM {_D})) WHERE table_lines > 0""",
    "link_keys": f"SELECT target, count(*) AS times, count(DISTINCT link) AS spellings FROM (SELECT {_KEY.format('link')} AS target, link FROM (SELECT unnest(out_links) AS link FROM retrieval_nodes)) WHERE target IS NOT NULL GROUP BY target",
}
