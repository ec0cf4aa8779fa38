import itertools
import re
from datetime import date

import regex

from lorespan.llm import survivors as V

SCHEMA = "request_id long, merge_group array<struct<slug string, page_path string, content string>>, slug string, request int"
FIELDS = ("title", "description", "tags", "sources", "body")


def simple_parse(content):
    """Another reading of the same rules."""
    m = re.match(r"﻿?(?:[^\S\n]*\r?\n)*---\r?\n((?:.*\n)*?)---\r?(?:\n|$)", content or "")
    if not m:
        return {}, (content or "").lstrip("﻿")
    fields, key = {}, None
    for line in m[1].split("\n"):
        line = line.rstrip("\r")
        k = re.match(r"^([A-Za-z_]+):(.*)$", line)
        if k:
            key, v = k[1].lower(), k[2].strip()
            fields[key] = v[1:-1].split(",") if re.fullmatch(r"\[.*\]", v) else [v] if v else []
            key = key if not v else None
        elif key and re.match(r"^\s*-(\s|$)", line):
            fields[key].append(line.strip()[1:])
        elif line.strip():
            key = None
    return fields, (content or "")[m.end() :]


def bare(v):
    v = v.strip()
    return v[1:-1].strip() if len(v) > 1 and v[0] == v[-1] and v[0] in "'\"" else v


def brute(rows, markers):
    marked, out = {m.lower() for m in markers if m}, set()
    good = lambda v: bool(regex.search(r"[\p{L}\p{N}]", v)) and v.lower() not in marked
    for request, group in rows:
        pages = [p for p in group or [] if p and p["slug"] is not None]
        if len({p["slug"] for p in pages}) < 2:
            continue
        best = {}
        for p in pages:
            fields, body = simple_parse(p["content"])
            values = {f: [bare(x) for x in fields.get(f, [])] for f in FIELDS} | {"body": [bare(body)]}
            usable = {f for f in FIELDS if any(map(good, values[f]))}
            one = lambda k: bare(fields[k][0]) if len(fields.get(k, [])) == 1 else ""
            sure = float(one("confidence")) if re.fullmatch(r"\d*\.?\d+", one("confidence")) else 0
            try:
                day = date.fromisoformat(one("updated")).toordinal() if re.fullmatch(r"\d{4}-\d\d-\d\d", one("updated")) else -1
            except ValueError:
                day = -1
            rank = (-(sure if sure <= 1 else 0), -day, p["slug"])
            for f in usable:
                best[f] = min(best.get(f, (rank,)), (rank,))
            best["canonical"] = min(best.get("canonical", (-len(usable), rank)), (-len(usable), rank))
        out |= {(request, f, r[-1][2]) for f, r in best.items()}
    return out


def found(spark, rows, markers=("TBD", "n/a", None)):
    df = spark.createDataFrame([(i, g, "x", 1) for i, g in rows], SCHEMA)
    got = V.found_survivors(df, spark.createDataFrame([(m,) for m in markers], "marker string")).collect()
    assert len(got) == len(set(got))
    return set(map(tuple, got))


def page(slug, content):
    return {"slug": slug, "page_path": "p", "content": content}


def test_rules(spark):
    a = "﻿\n\n---\r\nTitle: 'tbd'\r\ntags:\r\n- \"x\"\r\n  - y\r\nconfidence: .9\r\nupdated: 2025-02-30\r\n---\r\n\r\nBody\r\n"
    b = "---\ntitle: \" Good \"\ntags: [N/A, '—']\nsources: [a.pdf]\nconfidence: 0.5\nupdated: 2025-01-01\ndescription: ?\n---\n"
    c = "no front matter"
    rows = [
        (1, [page("a", a), page("b", b), page("c", c)]), (2, [page("a", None), page("b", None)]), (3, [page("a", a), page("a", b)]), (4, None), (5, []), (6, [page("a", a)]),
        (7, [page("z", b), page("y", b), None, page(None, a)]), (8, [page("a", "---\ntitle: x\n"), page("a", b), page("b", "---\nconfidence: 7\n---\nt")]), (1, [page("a", a), page("b", b), page("c", c)]),
    ]
    got = found(spark, rows)
    assert got == brute(rows, ("TBD", "n/a"))
    assert {(1, "title", "b"), (1, "tags", "a"), (1, "body", "a"), (1, "canonical", "a"), (1, "sources", "b"), (2, "canonical", "a"), (7, "title", "y"), (7, "canonical", "y")} <= got
    assert not {r for r in got if r[0] in (3, 4, 5, 6)}


def test_given_requests_equal_brute_force(spark, data):
    requests = spark.read.parquet(f"{data}/merge_requests.parquet")
    markers = spark.read.parquet(f"{data}/null_markers.parquet")
    rows = [(r.request_id, [p and p.asDict() for p in r.merge_group] if r.merge_group is not None else None) for r in requests.collect()]
    got = set(map(tuple, V.found_survivors(requests, markers).collect()))
    assert got == brute(rows, [r.marker for r in markers.collect()]) and len(got) > 100


def test_branch_and_bound_equals_all_choices():
    import random

    rng = random.Random(2)
    for _ in range(60):
        pages = {f"p{i}": {"x": str(rng.randrange(3)), "y": str(rng.randrange(3)), "z": str(rng.randrange(2))} for i in range(5)}
        candidates = [(f, s, (rng.randrange(3), rng.randrange(4)), {f: v[f]}) for s, v in pages.items() for f in v]
        needed = [("x", "y"), ("y", "z")]
        seen = {(a, b): {(v[a], v[b]) for v in pages.values()} for a, b in needed}
        got = V.best_bundles(candidates, needed, seen)
        best = None
        for choice in itertools.product(*([c for c in candidates if c[0] == f] for f in "xyz")):
            value = {f: c[3][f] for f, c in zip("xyz", choice)}
            if all((value[a], value[b]) in seen[a, b] for a, b in needed):
                key = (tuple(-sum(t) for t in zip(*(c[2] for c in choice))), [c[1] for c in choice])
                best = min(best or key, key)
        assert [got[f] for f in "xyz"] == best[1]


def test_dependency_keeps_values_of_one_page_together(spark):
    a = "---\ntitle: A\nconfidence: 0.9\n---\n"
    b = "---\ntitle: B\nsources: [b.pdf]\nconfidence: 0.5\n---\n"
    df = spark.createDataFrame([(1, [page("a", a), page("b", b)], "x", 1)], SCHEMA)
    none = spark.createDataFrame([], "marker string")
    bundles = {"title": ("title",), "sources": ("sources",)}
    free = {tuple(r) for r in V.survivors(df, none, bundles).collect()}
    bound = {tuple(r) for r in V.survivors(df, none, bundles, [("title", "sources")]).collect()}
    assert free == {(1, "title", "a"), (1, "sources", "b")} and bound == {(1, "title", "b"), (1, "sources", "b")}


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_partial_choice_equals_all_choices():
    import random

    rng, partial = random.Random(5), 0
    for _ in range(80):
        pages = {f"p{i}": {f: str(rng.randrange(3)) for f in "xyz" if rng.random() < 0.4} for i in range(5)}
        candidates = [(f, s, (rng.randrange(3), rng.randrange(-9, 4)), {f: v[f]}) for s, v in pages.items() for f in v]
        needed = [("x", "y"), ("y", "z")]
        seen = {(a, b): {(v[a], v[b]) for v in pages.values() if a in v and b in v} for a, b in needed}
        got = V.best_bundles(candidates, needed, seen)
        names, best = sorted({c[0] for c in candidates}), None
        for choice in itertools.product(*([c for c in candidates if c[0] == f] + [None] for f in names)):
            taken = {c[0]: c for c in choice if c}
            value = {f: c[3][f] for f, c in taken.items()}
            if all((value[a], value[b]) in seen[a, b] for a, b in needed if a in value and b in value):
                key = (-len(taken), [-sum(c[2][i] for c in taken.values()) for i in (0, 1)], [(f not in taken, taken[f][1] if f in taken else "") for f in names])
                best = min(best or key, key)
        want = {f: slug for f, (unfilled, slug) in zip(names, best[2]) if not unfilled}
        assert got == want
        partial += len(want) < len(names)
    assert partial > 10


def test_body_and_title_on_different_pages_still_survive(spark):
    a, b = "---\ntitle: A\ndescription: d\n---\n", "Only a body."
    df = spark.createDataFrame([(1, [page("a", a), page("b", b)], "x", 1)], SCHEMA)
    bundles = {"naming": ("title", "description"), "body": ("body",)}
    got = {tuple(r) for r in V.survivors(df, spark.createDataFrame([], "marker string"), bundles, [("body", "title")]).collect()}
    assert got == {(1, "naming", "a")}


def brute_bundles(rows, markers, bundles, needed):
    """All choices of one candidate, or none, for every bundle of every group."""
    marked, out = {m.lower() for m in markers if m}, set()
    good = lambda v: bool(regex.search(r"[\p{L}\p{N}]", v)) and v.lower() not in marked
    for request, group in rows:
        pages = [p for p in group or [] if p and p["slug"] is not None]
        if len({p["slug"] for p in pages}) < 2:
            continue
        read = []
        for p in pages:
            fields, body = V.parse_page(p["content"])
            values = {f: tuple([body] if f == "body" else fields.get(f, [])) for f in FIELDS}
            usable = {f: v for f, v in values.items() if any(map(good, v))}
            read.append((p["slug"], usable, round(V._confidence(fields.get("confidence", [])) * 10**12), V._updated(fields.get("updated", []))))
        options, names = [], sorted(bundles)
        for name in names:
            own = [(slug, (1, sum(f in usable for f in bundles[name]), sure, day), {f: usable[f] for f in bundles[name] if f in usable}) for slug, usable, sure, day in read if any(f in usable for f in bundles[name])]
            if own:
                options.append([(name, *c) for c in own] + [None])
        best = None
        for choice in itertools.product(*options):
            taken = [c for c in choice if c]
            value = {f: v for c in taken for f, v in c[3].items()}
            if all(any(u.get(a) == value[a] and u.get(b) == value[b] for _, u, _, _ in read) for a, b in needed if a in value and b in value):
                key = ([-sum(c[2][i] for c in taken) for i in range(4)], [(0, c[1]) if c else (1, "") for c in choice], [c[0] for c in taken])
                best = min(best or key, key)
        if best:
            out |= {(request, name, slug) for name, (_, slug) in zip(best[2], [x for x in best[1] if not x[0]])}
    return out


def test_given_requests_with_dependencies_equal_brute_force(spark, data):
    """The query p4_consistent, as it is registered, on all given requests."""
    from lorespan.llm import catalogue

    markers = spark.read.parquet(f"{data}/null_markers.parquet")
    requests = spark.read.parquet(f"{data}/merge_requests.parquet").collect()
    rows = list({r.request_id: (r.request_id, [p and p.asDict() for p in r.merge_group] if r.merge_group is not None else None) for r in requests}.values())
    got = {tuple(r) for r in catalogue.QUERIES["p4_consistent"](spark, data).collect()}
    want = brute_bundles(rows, [r.marker for r in markers.collect()], {"naming": ("title", "description"), "origin": ("tags", "sources"), "body": ("body",)}, [("body", "title"), ("body", "sources")])
    assert got == want and len(got) > 50


def test_many_markers_are_joined(spark, monkeypatch):
    rows = [(1, [page("a", "---\ntitle: TBD\n---\nx"), page("b", "---\ntitle: t\n---\n")])]
    want = found(spark, rows)
    monkeypatch.setattr(V, "MOST_MARKERS", 1)
    assert found(spark, rows) == want and (1, "title", "b") in want


def test_group_of_very_many_pages(spark):
    """10 000 pages of their own values: candidates are looked up by value, not tried one by one."""
    group = [page(f"s{i:05}", f"---\ntitle: t{i % 5000}\nsources: [f{i}.pdf]\nconfidence: 0.{i % 97:02}\n---\nbody {i}") for i in range(10_000)]
    df = spark.createDataFrame([(1, group, "x", 1)], SCHEMA)
    bundles = {"naming": ("title",), "origin": ("sources",), "body": ("body",)}
    got = {r.bundle: r.slug for r in V.survivors(df, spark.createDataFrame([], "marker string"), bundles, [("body", "title"), ("body", "sources")]).collect()}
    assert set(got) == set(bundles) and len(set(got.values())) <= 2 and got["body"] == got["origin"]
