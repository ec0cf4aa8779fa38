"""Column functions over texts of pages: words, titles, links, snippets, redaction, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that carry no meaning for search.
STOP_WORDS = (
    "的 是 了 什么 在 有 和 与 对 从 the is a an what how are was were do does did be been being have has had "
    "it its in on at to for of with by this that these those"
).split()

#: White space as search sees it, the same in every engine's regular expressions.
SPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"

#: What separates the words of a query; a corpus is separated at full stops as well.
QUERY_BREAK = "[" + SPACE + r""",，。！？、；：""''（）()\-_/\\·~～…]+"""
CORPUS_BREAK = "[" + SPACE + r""",，。！？、；：""''（）()\-_/\\·~～….]+"""

HAN = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]"


def _spread(token: Column) -> Column:
    """A piece; of three or more characters, if Chinese, also its pairs and its single characters."""
    # Extraction is linear in the length, unlike a substring at every place; characters are code points, not halves of them.
    chars = F.regexp_extract_all(token, F.lit(r"(?s)(.)"), F.lit(1))
    pairs = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.concat(a, b))
    singles = F.filter(chars, lambda c: ~c.isin(*STOP_WORDS))
    return F.when(token.rlike(HAN) & (F.length(token) > 2), F.concat(pairs, singles, F.array(token))).otherwise(F.array(token))


def token_rows(rows: DataFrame, text: str, breaks: str = CORPUS_BREAK) -> DataFrame:
    """``rows`` with a ``token`` for each word of a text column, repeats included, instead of the text.

    Words are the lower-cased pieces of two or more characters that are no stop words; see :func:`_spread` for Chinese.
    """
    rest = [c for c in rows.columns if c != text]
    pieces = rows.select(*rest, F.explode(F.split(F.lower(text), breaks)).alias("token")).where((F.length("token") > 1) & ~F.col("token").isin(*STOP_WORDS))
    return pieces.select(*rest, F.explode(_spread(F.col("token"))).alias("token"))


def tokens(text: Column, breaks: str = CORPUS_BREAK) -> Column:
    """The same words as an array, for short texts."""
    pieces = F.filter(F.split(F.lower(text), breaks), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))
    return F.flatten(F.transform(pieces, _spread))


def query_tokens(text: Column) -> Column:
    """The distinct words of a query; only these can match, whether or not the corpus splits them further."""
    return F.array_distinct(tokens(text, QUERY_BREAK))


def _equals(word: str):
    return lambda t: t == word


def token_counts(text: Column, words: list[str], breaks: str = CORPUS_BREAK) -> Column:
    """``length``, the number of words of a text, and ``tf``, how often each of ``words`` is one of them; in one pass over the text."""
    pieces = F.filter(F.split(F.lower(text), breaks), lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))
    spread = F.when(text.rlike(HAN), F.flatten(F.transform(pieces, _spread))).otherwise(pieces)
    count = lambda t: F.struct(F.size(t).alias("length"), F.array(*(F.size(F.filter(t, _equals(w))) for w in words)).alias("tf"))
    return F.get(F.transform(F.array(spread), count), F.lit(0))  # bound once, used several times


#: The front matter's fences, the opening one within the first six lines.
FRONT = r"\A\x{feff}?(?:[^\n]*\n){0,5}?---[ \t]*\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n|\z)"

#: A field of a front matter: its key, the value behind it, and the lines of a list under it.
ENTRY = r"(?:\A|\n)([A-Za-z_][A-Za-z0-9_-]*)[ \t]*:([^\n]*)((?:\n[ \t]*-(?:[ \t][^\n]*)?)*)"

#: A list of links without brackets around it.
BARE_LINKS = r"\A\[\[[^\]]+\]\](?:[ \t]*,[ \t]*\[\[[^\]]+\]\])+\z"


def front_block(text: Column) -> Column:
    """The lines of the front matter between its fences, or an empty text."""
    return F.regexp_extract(text, FRONT, 1)


def page_body(text: Column) -> Column:
    """What stands behind the front matter, or the whole text."""
    return F.regexp_replace(text, FRONT, "")


def bare(value: Column) -> Column:
    """Trimmed, freed of one pair of quotes, trimmed again."""
    blank = F.lit(" \t\r")
    return F.btrim(F.regexp_replace(F.btrim(value, blank), r"""(?s)\A(?:"(.*)"|'(.*)')\z""", "$1$2"), blank)


def front_matter(text: Column) -> Column:
    """The front matter's fields in order, repeats included: an array of ``field`` and ``entries``, a scalar being a list of one.

    Lists are ``[a, b]``, lines ``- a`` under the key, or links one behind the other.
    """
    block = front_block(text)
    part = lambda i: F.regexp_extract_all(block, F.lit(ENTRY), F.lit(i))

    def field(x: Column) -> Column:
        value = F.btrim(x["value"], F.lit(" \t\r"))
        split = lambda v: F.transform(F.split(v, ","), bare)
        entries = (
            F.when(value == "", F.transform(F.regexp_extract_all(x["items"], F.lit(r"-([^\n]*)"), F.lit(1)), bare))
            .when(value.rlike(BARE_LINKS), split(value))
            .when(value.startswith("[") & value.endswith("]") & ~value.startswith("[["), split(F.regexp_replace(value, r"(?s)\A\[(.*)\]\z", "$1")))
            .otherwise(F.array(bare(value)))
        )
        return F.struct(x["field"].alias("field"), F.filter(entries, lambda e: e != "").alias("entries"))

    return F.transform(F.arrays_zip(part(1).alias("field"), part(2).alias("value"), part(3).alias("items")), field)


def front_entries(fields: Column, *names: str) -> Column:
    """All entries of the fields of these names."""
    return F.flatten(F.transform(F.filter(fields, lambda x: F.lower(x["field"]).isin(*names)), lambda x: x["entries"]))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.md$", "")


def page_title(text: Column, path: Column) -> Column:
    """The front matter's title, else the first heading of level 1, else the file's name in words."""
    front = F.regexp_extract(text, r"""\A---\n(?:(?s:.)*?\n)?title:[ \t]*["']?([^\n]+?)["']?[ \t]*(?:\n|\z)""", 1)
    heading = F.regexp_extract(text, r"(?:\A|\n)#[ \t]+([^\n]+)", 1)
    named = F.replace(file_stem(path), F.lit("-"), F.lit(" "))
    return F.coalesce(F.nullif(F.trim(front), F.lit("")), F.nullif(F.trim(heading), F.lit("")), named)


def wikilinks(text: Column) -> Column:
    """Targets of ``[[target]]`` and ``[[target|label]]`` in order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1)), F.trim)


#: A fenced block of code, a span of code, a lone back quote, or a piece of other text.
CODE_OR_TEXT = r"```(?s:.*?)```|`[^`\n]+`|`|[^`]+"

#: Links between pages, with a label and without.
LABELLED, UNLABELLED = r"\[\[[ \t]*([^\]|\n]*[^\]|\n \t])[ \t]*\|[ \t]*([^\]\n]*[^\]\n \t])[ \t]*\]\]", r"\[\[[ \t]*([^\]|\n]*[^\]|\n \t])[ \t]*(?:\|[ \t]*)?\]\]"


def markdown_links(text: Column) -> Column:
    """``[[target|label]]`` and ``[[target]]`` as links of Markdown to ``#target``."""
    return F.regexp_replace(F.regexp_replace(text, LABELLED, "[$2](#$1)"), UNLABELLED, "[$1](#$1)")


def outside_code(text: Column, change) -> Column:
    """A text changed outside of its fenced blocks and spans of code."""
    parts = F.regexp_extract_all(text, F.lit(CODE_OR_TEXT), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("`"), x).otherwise(change(x))), "")


def image_urls(text: Column) -> Column:
    """The addresses of ``![alt](url)``, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)))


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase stands in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / F.lit(len(phrase))).cast("int")


def snippet(text: Column, phrase: str, context: int = 80) -> Column:
    """The surroundings of the first match of a phrase, in any case; else the beginning."""
    at = F.locate(phrase.lower(), F.lower(text))
    start = F.greatest(at - 1 - context, F.lit(0))
    end = F.least(at - 1 + len(phrase) + context, F.length(text))
    inner = F.replace(F.substring(text, start + 1, end - start), F.lit("\n"), F.lit(" "))
    whole = F.concat(F.when(start > 0, "...").otherwise(""), inner, F.when(end < F.length(text), "...").otherwise(""))
    return F.when(at == 0, F.replace(F.substring(text, 1, 2 * context), F.lit("\n"), F.lit(" "))).otherwise(whole)


#: Where a run of letters, digits and underscores begins or ends, in ASCII as in the patterns' origin.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: What is taken out of a text, in this order, and what is put in its place; ``\b`` is an edge of ASCII words.
SECRETS = (
    (r"(?i)<private\b[^>]*>(?s:.*?)</private>", "<private>[REDACTED:private]</private>"),
    (r"(?i)\b([a-z][a-z0-9+.\-]*://)([^/\s@]+@)", "$1[REDACTED:secret]@"),
    (r"(?i)(\bAuthorization\s*:\s*Bearer\s+)([A-Za-z0-9._~+/=\-]{8,})", "$1[REDACTED:secret]"),
    (r"""(?i)\b([A-Za-z0-9_.\-]*(?:api[_\-]?key|token|secret|password|passwd)[A-Za-z0-9_.\-]*\s*[:=]\s*)([^\s"',`<>]+)""", "$1[REDACTED:secret]"),
    (r"\b(?:sk-[A-Za-z0-9_\-]{10,}|sk-proj-[A-Za-z0-9_\-]{10,}|ghp_[A-Za-z0-9_]{20,}|xox[baprs]-[A-Za-z0-9\-]{10,})\b", "[REDACTED:secret]"),
)

#: Fixed value: keys of an event whose values are secret.
SECRET_KEY = r"(?i)(?:api[_-]?key|token|secret|password|passwd)"


def redacted(text: Column) -> Column:
    """A text without private blocks, credentials in addresses, bearer tokens, values of secret keys, and well-known tokens."""
    for pattern, safe in SECRETS:
        text = F.regexp_replace(text, pattern.replace(r"\b", EDGE), safe)
    return text


def slug(text: Column, most: int = 50) -> Column:
    """Lower-cased letters and digits joined by single hyphens, at most ``most`` characters, or ``query``."""
    joined = F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[\s]+", "-"), r"[^\p{L}\p{N}\-]+", ""), F.lit("-"))
    return F.coalesce(F.nullif(F.btrim(F.substring(F.regexp_replace(joined, "-+", "-"), 1, most), F.lit("-")), F.lit("")), F.lit("query"))


def fnv36(text: Column) -> Column:
    """FNV-1a of 32 bits over the code points of a text, in base 36."""
    # Offset basis and prime of FNV-1a.
    points = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(.)"), F.lit(1)), lambda c: F.ascii(c).cast("long"))
    # 16777619 is 2^24 + 403: so the product stays within a long and is cut to 32 bits.
    hashed = F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.conv(hashed.cast("string"), 10, 36))


def script_counts(text: Column) -> Column:
    """Characters of the scripts that tell languages apart."""
    count = lambda name, cls: (F.length(text) - F.length(F.regexp_replace(text, cls, ""))).alias(name)
    return F.struct(
        count("han", r"\p{IsHan}"), count("kana", r"[\x{3040}-\x{30ff}]"), count("hangul", r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}]"),
        count("arabic", r"[\x{600}-\x{6ff}]"), count("cyrillic", r"[\x{400}-\x{4ff}]"), count("devanagari", r"[\x{900}-\x{97f}]"),
        count("thai", r"[\x{e00}-\x{e7f}]"), count("hebrew", r"[\x{590}-\x{5ff}]"), count("greek", r"[\x{370}-\x{3ff}]"), count("latin", r"[A-Za-z\x{c0}-\x{24f}]"),
    )


def main_script(text: Column) -> Column:
    """The script of most characters, Japanese before Chinese if any kana occurs, ``Latin`` if no other has two."""
    c = script_counts(text)
    others = ("hangul", "arabic", "cyrillic", "devanagari", "thai", "hebrew", "greek")
    most = F.greatest(*(c[o] for o in others), c["han"])
    named = F.when(most < 2, F.lit("Latin")).when(c["han"] == most, F.lit("Chinese"))
    for o in others:
        named = named.when(c[o] == most, F.lit(o.capitalize()))
    return F.when((c["kana"] > 0) & (c["kana"] + c["han"] >= 2), F.lit("Japanese")).otherwise(named)


def network_kind(link: Column) -> Column:
    """``loopback``, ``lan``, ``public`` or ``invalid`` by the host of an address."""
    host = F.lower(F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return (
        F.when(host == "", "invalid")
        .when(host.rlike(r"^(localhost|127\.[0-9.]+|::1)$"), "loopback")
        .when(host.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|169\.254\.)|\.local$|^[^.]+$"), "lan")
        .otherwise("public")
    )


def sentences_with_signal(text: Column) -> Column:
    """Lines of 32 or more characters that state a decision, cause or lesson, each once in any case, at most 8."""
    lines = F.transform(F.split(text, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"^[ \t]*(?:[-*+]|[0-9]+\.)[ \t]+", "")))
    hits = F.filter(lines, lambda x: (F.length(x) >= 32) & F.lower(x).rlike(r"(decid|because|therefore|should|must|lesson|conclu|confirm|结论|决定|因为|应该|必须)"))
    return F.slice(F.array_distinct(hits), 1, 8)


#: Frequent words by which languages in Latin script are told apart.
FUNCTION_WORDS = {
    "en": "the and of to is that for with".split(),
    "de": "der die und das ist nicht mit von".split(),
    "fr": "le les est une des dans pour du".split(),
    "es": "el los una que por las del con".split(),
    "pt": "não uma que os com para do em".split(),
}


def language(text: Column) -> Column:
    """The language of a text: by script, or in Latin script the one whose frequent words occur most (of equal ones the first), else English."""
    script = main_script(text)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    counts = []
    for i, (name, own) in enumerate(FUNCTION_WORDS.items()):
        counts.append(F.struct((-_members(words, own)).alias("less"), F.lit(i).alias("i"), F.lit(name).alias("name")))
    return F.when(script == "Latin", F.array_min(F.array(*counts))["name"]).otherwise(F.lower(script))


def _members(words: Column, own: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(own)))


def context_budget(size: Column) -> Column:
    """How a context of ``size`` characters is shared: 15 % for the answer, 5 % index, 50 % pages, and the most of one page."""
    pages = F.floor(size * F.lit(0.5))
    return F.struct(F.floor(size * F.lit(0.15)).alias("answer"), F.floor(size * F.lit(0.05)).alias("index"), pages.alias("pages"), F.least(pages, F.greatest(F.lit(5000), F.floor(size * F.lit(0.3)))).alias("one_page"))
