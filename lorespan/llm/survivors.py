"""The surviving record of a group of duplicates, field by field (problem 4)."""

from __future__ import annotations

import heapq
import re
from datetime import date
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.session import written

#: Most markers of "no value" that are given to every task; more are joined.
MOST_MARKERS = 10_000

#: The fields of a page that can survive.
FIELDS = ("title", "description", "tags", "sources", "body")

KEY = re.compile(r"([A-Za-z_]+):(.*)", re.S)
ITEM = re.compile(r"\s*-(?:\s+(.*)|\s*)$", re.S)
NUMBER = re.compile(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")
#: Earlier than all days.
NEVER = -(10**6)

DAY = re.compile(r"(\d{4})-(\d{2})-(\d{2})")


def _bare(value: str) -> str:
    """Trimmed, freed of one pair of enclosing quotes, trimmed again."""
    value = value.strip()
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
        value = value[1:-1].strip()
    return value


def parse_page(content: str | None) -> tuple[dict[str, list[str]], str]:
    """Front matter, as lists of bare values by lower-cased key, and the bare body of a page.

    Before the front matter only a BOM and blank lines may stand.  A scalar is a list of one.  A key given twice has its last
    value.  Without a closing line all is body.
    """
    text = content or ""
    text = text[1:] if text.startswith("\ufeff") else text
    lines = text.split("\n")
    plain = [line[:-1] if line.endswith("\r") else line for line in lines]
    at = 0
    while at < len(plain) and not plain[at].strip():
        at += 1
    if at == len(plain) or plain[at] != "---" or "---" not in plain[at + 1 :]:
        return {}, _bare(text)
    end = plain.index("---", at + 1)
    fields: dict[str, list[str]] = {}
    open_list: list[str] | None = None
    for line in plain[at + 1 : end]:
        if m := KEY.fullmatch(line):
            value = m[2].strip()
            if value.startswith("[") and value.endswith("]") and len(value) >= 2:
                fields[m[1].lower()], open_list = [_bare(v) for v in value[1:-1].split(",")], None
            elif value:
                fields[m[1].lower()], open_list = [_bare(value)], None
            else:
                open_list = fields[m[1].lower()] = []
        elif open_list is not None and (m := ITEM.match(line)):
            open_list.append(_bare(m[1] or ""))
        elif line.strip():
            open_list = None
    return fields, _bare("\n".join(lines[end + 1 :]))


def _confidence(values: list[str]) -> float:
    number = float(values[0]) if len(values) == 1 and NUMBER.fullmatch(values[0]) else 0.0
    return number if 0 <= number <= 1 else 0.0


def _updated(values: list[str]) -> int:
    m = DAY.fullmatch(values[0]) if len(values) == 1 else None
    try:
        return (date(*map(int, m.groups())) - date(1970, 1, 1)).days if m else NEVER
    except ValueError:
        return NEVER


def parsed_pages(requests: DataFrame, id_col: str = "request_id", group_col: str = "merge_group") -> DataFrame:
    """``request``, ``place``, ``slug``, ``confidence``, ``updated`` (days since 1970, or before all) and ``values`` (field -> entries) of each page.

    Pages without a slug are left out, and requests with fewer than two distinct slugs.  Repeated rows give repeated pages, which
    change nothing in what is chosen, so contents are never shuffled.
    """
    several = requests.where(F.size(F.array_distinct(F.filter(requests[group_col]["slug"], lambda x: x.isNotNull()))) >= 2)
    pages = several.select(requests[id_col].alias("request"), F.posexplode(requests[group_col]).alias("place", "page"))
    pages = pages.select("request", "place", "page.slug", "page.content").where("slug is not null")
    kind = pages.schema["request"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.map_(pa.string(), pa.list_(pa.string()))
        for batch in batches:
            sure, days, values = [], [], []
            for content in batch.column(3).to_pylist():
                fields, body = parse_page(content)
                sure.append(_confidence(fields.get("confidence", [])))
                days.append(_updated(fields.get("updated", [])))
                values.append([(f, [body] if f == "body" else fields.get(f, [])) for f in FIELDS])
            new = [pa.array(sure, pa.float64()), pa.array(days, pa.int32()), pa.array(values, strings)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], names=["request", "place", "slug", "confidence", "updated", "values"])

    return pages.mapInArrow(parse, f"request {kind}, place int, slug string, confidence double, updated int, values map<string,array<string>>")


def usable_fields(pages: DataFrame, markers: DataFrame, marker_col: str = "marker") -> DataFrame:
    """One row per page: ``request``, ``place``, ``slug``, ``confidence``, ``updated`` and ``fields``, a map of its usable fields
    to a digest of their entries.

    An entry counts if it has a letter or digit and is no marker of "no value" in any case; a field is usable if an entry
    counts.  Up to ``MOST_MARKERS`` markers are told from entries where the page is, more by a join.
    """
    none = markers.select(F.lower(markers[marker_col]).alias("entry")).where("entry is not null").distinct()
    page = ["request", "place", "slug", "confidence", "updated"]
    digest = lambda entries: F.sha2(F.concat_ws("\x1f", entries), 256)
    readable = lambda x: x.rlike(r"[\p{L}\p{N}]")
    few = none.limit(MOST_MARKERS + 1).collect()
    if len(few) <= MOST_MARKERS:
        marked = F.array(*(F.lit(r["entry"]) for r in few)) if few else F.expr("cast(array() as array<string>)")
        counts = lambda x: readable(x) & ~F.array_contains(marked, F.lower(x))
        usable = F.map_filter("values", lambda _, entries: F.exists(entries, counts))
        return pages.select(*page, F.transform_values(usable, lambda _, entries: digest(entries)).alias("fields"))
    fields = pages.select(*page, F.explode("values").alias("field", "entries"))
    entries = fields.select(*page, "field", digest("entries").alias("digest"), F.explode("entries").alias("own")).where(readable(F.col("own")))
    kept = entries.withColumn("entry", F.lower("own")).join(none, "entry", "left_anti").select(*page, F.struct("field", "digest").alias("one"))
    all_ = kept.unionByName(pages.select(*page, F.lit(None).cast("struct<field:string,digest:string>").alias("one")))
    return all_.groupBy(*page).agg(F.map_from_entries(F.collect_set("one")).alias("fields"))


def best_bundles(candidates: list[tuple[str, str, tuple, dict]], dependencies: list[tuple[str, str]], seen: dict[tuple[str, str], set]) -> dict[str, str]:
    """The slug for each bundle that is filled: the consistent choice of most bundles, then of greatest trust, by branch and bound.

    ``candidates`` are (bundle, slug, trust, values by field), ``seen`` has for each dependency, a pair of fields, the pairs of
    values that stand together on some page.  A choice is consistent if for each dependency whose fields both survive the
    surviving values stand together.  Trust of a choice is the sum over its bundles, entry by entry, compared from the
    first entry on; of equal ones the one of the smallest slugs, in the bundles' order.  A bundle may stay unfilled, which
    no dependency touches, so there is always a choice; one that fills more bundles goes before any that fills fewer.

    Candidates are kept by the values that dependencies bind, so a branch looks only at those that can stand with what is
    chosen, the most trusted first, and ends where the most that the bundles left can add is less than the best choice has.
    A bundle has one candidate for each combination of its bound values in the group, however many pages have it.
    """
    by: dict[str, list[tuple[tuple, tuple, dict]]] = {}
    for bundle, slug, trust, values in candidates:
        by.setdefault(bundle, []).append(((0, slug), (1, *trust), values))
    for own in by.values():
        own.sort(key=lambda c: (tuple(-x for x in c[1]), c[0]))
        if dependencies:
            own.append(((1, ""), (0,) * len(own[0][1]), {}))  # unfilled
    names = sorted(by)
    plus = lambda a, b: tuple(x + y for x, y in zip(a, b))
    zero = (0,) * len(next(iter(by.values()))[0][1]) if by else ()
    rest = [zero]
    for name in reversed(names):  # the most that the bundles from here on can add
        rest.append(plus(rest[-1], by[name][0][1]))
    rest.reverse()
    # Places of a bundle's candidates by the value of a bound field, and under None of those without it; partners of a value.
    ends = {f for pair in dependencies for f in pair}
    places: dict[tuple[str, str], dict[str | None, list[int]]] = {}
    for name, own in by.items():
        for f in ends & {f for _, _, v in own for f in v}:
            for i, (_, _, v) in enumerate(own):
                places.setdefault((name, f), {}).setdefault(v.get(f), []).append(i)
    partners: dict[tuple[str, str], dict[str, list[str]]] = {}
    for (a, b), pairs in seen.items():
        for x, y in pairs:
            partners.setdefault((a, b), {}).setdefault(x, []).append(y)
            partners.setdefault((b, a), {}).setdefault(y, []).append(x)
    best: tuple[tuple, list[tuple]] | None = None
    chosen: list[tuple] = []
    values: dict[str, str] = {}

    def consistent(new: dict) -> bool:
        joined = values | new
        return all((joined[a], joined[b]) in seen.get((a, b), ()) for a, b in dependencies if a in joined and b in joined and (a in new or b in new))

    def possible(name: str) -> Iterator[tuple]:
        """Candidates that the shortest list of a bound value allows, the most trusted first."""
        lists = []
        for a, b in (*dependencies, *((b, a) for a, b in dependencies)):
            if a in values and (name, b) in places:
                own = places[name, b]
                lists.append([own[v] for v in (*partners.get((a, b), {}).get(values[a], ()), None) if v in own])
        if not lists:
            return iter(by[name])
        return (by[name][i] for i in heapq.merge(*min(lists, key=lambda x: sum(map(len, x)))))

    def branch(k: int, trust: tuple) -> None:
        nonlocal best
        if k == len(names):
            if best is None or trust > best[0] or (trust == best[0] and chosen < best[1]):
                best = trust, list(chosen)
            return
        for slug, own, new in possible(names[k]):
            bound = plus(plus(trust, own), rest[k + 1])
            if best is not None and (bound < best[0] or (bound == best[0] and [*chosen, slug] > best[1][: k + 1])):
                if bound < best[0]:
                    break
                continue
            if dependencies and not consistent(new):
                continue
            added = {f: v for f, v in new.items() if f not in values} if dependencies else {}
            values.update(added)
            chosen.append(slug)
            branch(k + 1, plus(trust, own))
            chosen.pop()
            for f in added:
                del values[f]

    branch(0, zero)
    return {name: slug for name, (unfilled, slug) in zip(names, best[1]) if not unfilled}


def survivors(
    requests: DataFrame,
    markers: DataFrame,
    bundles: dict[str, tuple[str, ...]],
    dependencies: list[tuple[str, str]] = (),
    whole: tuple[str, ...] = (),
    id_col: str = "request_id",
    group_col: str = "merge_group",
) -> DataFrame:
    """``id_col``, ``bundle``, ``slug``: the page of each group that supplies each bundle of fields as a whole.

    A page's trust for a bundle is the number of the bundle's fields usable in it, its confidence, and its day of update, in
    this order; of equal pages the smallest slug goes first.  A page can supply a bundle if one of its fields is usable; a
    bundle named in ``whole`` is supplied even if none is.  ``dependencies`` are pairs of fields whose surviving values must
    stand together on a page of the group.

    Method: consistent bundles by branch and bound (:func:`best_bundles`).  Before the shuffle to the groups candidates are
    reduced to those a best choice can have: for a bundle that no dependency touches the page of greatest trust, for others
    the one of greatest trust for each combination of their values.  So a group of very many pages is reduced in
    parallel, and what reaches its search does not grow with its copies.

    Null, empty and one-page groups give no rows, pages with null content have no usable field, a slug named twice stands
    for the better of its pages.  Repeated rows count once.  If no consistent choice fills all bundles, the best one that
    fills most gives its rows.  Other columns aren't read.
    """
    dependencies = list(dependencies)
    bound_fields = sorted({f for pair in dependencies for f in pair})
    pages = usable_fields(parsed_pages(requests, id_col, group_col), markers)
    if dependencies:  # read twice below; digests, no contents
        pages = written(pages, "pages")

    def bundle(name: str, own: tuple[str, ...]):
        bound = [f for f in own if f in bound_fields]
        usable = F.size(F.array_intersect(F.map_keys("fields"), F.array(*(F.lit(f) for f in own))))
        values = F.map_filter("fields", lambda k, _: k.isin(bound) if bound else F.lit(False))
        return F.struct(F.lit(name).alias("bundle"), usable.alias("usable"), F.lit(name in whole).alias("whole"), values.alias("values"))

    listed = F.array(*(bundle(name, own) for name, own in bundles.items()))
    each = pages.select("request", "slug", "confidence", "updated", F.explode(listed).alias("b")).where("b.usable > 0 or b.whole")
    # The greatest trust, then the smallest slug: max_by with the order of slugs turned round.
    trust = F.struct(F.col("b.usable").alias("usable"), "confidence", "updated")
    grouped = each.select("request", "slug", F.col("b.bundle").alias("bundle"), F.array_sort(F.map_entries("b.values")).alias("values"), trust.alias("trust"))
    top = grouped.groupBy("request", "bundle", "values", "trust").agg(F.min("slug").alias("slug"))
    rows = top.groupBy("request", "bundle", "values").agg(F.max(F.struct("trust", "slug")).alias("best"))
    rows = rows.select("request", "bundle", "values", "best.slug", "best.trust.usable", "best.trust.confidence", "best.trust.updated")
    if dependencies:  # pages' own combinations of values, without trust, for the test of consistency
        own = F.map_filter("fields", lambda k, _: k.isin(bound_fields))
        together = pages.select("request", F.lit(None).cast("string").alias("bundle"), F.array_sort(F.map_entries(own)).alias("values")).distinct()
        rows = rows.unionByName(together, allowMissingColumns=True)
    kind = rows.schema["request"].dataType.simpleString()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(request, group: list[dict]) -> list[tuple]:
            candidates, seen = [], {}
            for row in group:
                values = {v["key"]: v["value"] for v in row["values"]}
                if row["bundle"] is None:
                    for a, b in dependencies:
                        if a in values and b in values:
                            seen.setdefault((a, b), set()).add((values[a], values[b]))
                else:
                    candidates.append((row["bundle"], row["slug"], (row["usable"], round(row["confidence"] * 10**12), row["updated"]), values))
            return [(request, bundle, slug) for bundle, slug in best_bundles(candidates, dependencies, seen).items()]

        def out(done: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            request, bundle, slug = zip(*done) if done else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(request, like), pa.array(bundle, pa.string()), pa.array(slug, pa.string())], names=["request", "bundle", "slug"])

        last, group, like = None, [], None
        for batch in batches:
            like, done = batch.column(0).type, []
            for row in batch.to_pylist():
                if group and row["request"] != last:
                    done += solve(last, group)
                    group = []
                last = row["request"]
                group.append(row)
            yield out(done, like)
        if group:
            yield out(solve(last, group), like)

    chosen = rows.repartition("request").sortWithinPartitions("request").mapInArrow(choose, f"request {kind}, bundle string, slug string")
    return chosen.withColumnRenamed("request", id_col)


def found_survivors(requests: DataFrame, markers: DataFrame) -> DataFrame:
    """``request_id``, ``field_name``, ``slug``: the page that supplies each field, and the one to keep (``canonical``)."""
    bundles = {f: (f,) for f in FIELDS} | {"canonical": FIELDS}
    return survivors(requests, markers, bundles, whole=("canonical",)).withColumnRenamed("bundle", "field_name")
