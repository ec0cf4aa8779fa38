"""Structure of Markdown that needs a pass over lines: generated file blocks, and chunks that respect headings, fences and tables.

Each function reads one text; the operators apply them to batches of rows in parallel.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
OPEN_FILE = re.compile(r"\s*-{3}\s*FILE:\s*(.*?)\s*-{3}\s*", re.I)
END_FILE = re.compile(r"\s*-{3}\s*END\s+FILE\s*-{3}\s*", re.I)
HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*$")
FRONT = re.compile(r"\A---\r?\n.*?\n---\r?(?:\n|\Z)", re.S)


def _lines(text: str) -> Iterator[tuple[int, str, bool]]:
    """(start, line with its end, inside a fence) of every line; the fence lines themselves count as inside."""
    fence, at = "", 0
    for line in text.splitlines(keepends=True):
        mark = FENCE.match(line)
        inside = bool(fence)
        if mark and not fence:
            fence, inside = mark[1], True
        elif mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence):
            fence = ""
        yield at, line, inside
        at += len(line)


def safe_path(path: str) -> bool:
    """Relative, below ``wiki/``, without parent steps or control characters."""
    plain = path.replace("\\", "/")
    return bool(path.strip()) and not re.search(r"[\x00-\x1f]", path) and plain.startswith("wiki/") and ".." not in plain.split("/")


def file_blocks(text: str) -> Iterator[tuple[str, str, str]]:
    """(path, content, problem) of every block between FILE markers; markers inside fences are text.

    A block without an end is ``truncated``, one with an empty or unsafe path ``empty-path`` or ``unsafe-path``; else the problem is empty.
    """
    path, body = None, []
    problem = lambda: "empty-path" if not path else "" if safe_path(path) else "unsafe-path"
    fenced = ""
    for line in text.splitlines():
        if path is None:
            if m := OPEN_FILE.fullmatch(line):
                path, body, fenced = m[1], [], ""
            continue
        mark = FENCE.match(line)
        if mark and not fenced:
            fenced = mark[1]
        elif mark and mark[1][0] == fenced[0] and len(mark[1]) >= len(fenced):
            fenced = ""
        if not fenced and END_FILE.fullmatch(line):
            yield path, "\n".join(body), problem()
            path = None
        else:
            body.append(line)
    if path is not None:
        yield path, "\n".join(body), "truncated"


@dataclass(frozen=True)
class ChunkSizes:
    """Characters: what a chunk aims at, its most, its least (smaller ones join the next), and the overlap within a section."""

    target: int = 1000
    most: int = 1500
    least: int = 200
    overlap: int = 200


def _atoms(text: str) -> Iterator[tuple[int, int, bool, str]]:
    """(start, end, divisible, heading path) of paragraphs, fences and tables."""
    trail: list[tuple[int, str]] = []
    begin, kind, path = 0, "", ""
    end = 0
    for at, line, inside in _lines(text):
        now = "fence" if inside else "table" if line.lstrip().startswith("|") else "blank" if not line.strip() else "text"
        heading = None if inside else HEADING.match(line)
        if kind and (heading or now != kind):
            yield begin, end, kind == "text", path
            kind = ""
        if heading:
            level = len(heading[1])
            trail = [*((n, h) for n, h in trail if n < level), (level, f"{heading[1]} {heading[2]}")]
            path = " > ".join(h for _, h in trail)
        elif now != "blank" and not kind:
            begin, kind = at, now
        end = at + len(line)
    if kind:
        yield begin, end, kind == "text", path


def _divided(text: str, start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """A paragraph cut at the last line, sentence or word end within ``most``, else anywhere."""
    while end - start > most:
        window = text[start : start + most]
        cut = max(window.rfind("\n"), -1) + 1
        if cut <= most // 2:
            ends = [m.end() for m in re.finditer(r"[.!?。！？]\s*", window)]
            cut = ends[-1] if ends and ends[-1] > most // 2 else window.rfind(" ") + 1
        cut = cut if cut > most // 4 else most
        yield start, start + cut
        start += cut
    yield start, end


def chunks(text: str, sizes: ChunkSizes = ChunkSizes()) -> Iterator[tuple[str, str, int, int, bool]]:
    """(text, heading path, start, end, oversized) of the chunks of a page, without its front matter."""
    skip = m.end() if (m := FRONT.match(text)) else 0
    units = []
    for a, b, divisible, path in _atoms(text[skip:]):
        for x, y in _divided(text, a + skip, b + skip, sizes.target) if divisible else [(a + skip, b + skip)]:
            units.append((x, y, path))
    packed: list[list] = []
    for a, b, path in units:
        last = packed[-1] if packed else None
        fits = last and last[2] == path and (b - last[0] <= sizes.target or (last[1] - last[0] < sizes.least and b - last[0] <= sizes.most))
        if fits:
            last[1] = b
        else:
            packed.append([a, b, path])
    for i, (a, b, path) in enumerate(packed):
        back = 0
        if i and packed[i - 1][2] == path:
            back = min(sizes.overlap, packed[i - 1][1] - packed[i - 1][0], max(0, sizes.most - (b - a)))
        yield text[a - back : b].strip(), path, a - back, b, b - a > sizes.most


def per_row(rows: DataFrame, id_col: str, text_col: str, function: Callable[[str], Iterator[tuple]], columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """``id_col``, ``place`` and the columns of every tuple that the function gives for a row's text; null texts give none."""
    kind = rows.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, place, *values) for i, text in enumerate(batch.column(1).to_pylist()) if text for place, values in enumerate(function(text))]
            at, place, *rest = zip(*found) if found else ((), (), *(() for _ in columns))
            arrays = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(place, pa.int32()), *(pa.array(v, t) for v, (_, t, _) in zip(rest, columns))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "place", *(n for n, _, _ in columns)])

    schema = ", ".join([f"key {kind}", "place int", *(f"{n} {t}" for n, _, t in columns)])
    return rows.select(rows[id_col].alias("key"), rows[text_col].alias("text")).mapInArrow(apply, schema).withColumnRenamed("key", id_col)
