"""Queries on blocks inside documents: generated files, reviews, audit lines, chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.functions import blocks as B
from lorespan.operators.logs import parsed_lines
from lorespan.session import table


def file_blocks(spark: SparkSession, folder: str) -> DataFrame:
    columns = [("path", pa.string(), "string"), ("content", pa.string(), "string"), ("problem", pa.string(), "string")]
    return B.per_row(table(spark, folder, "documents", spread=True), "doc_id", "text", B.file_blocks, columns)


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    columns = [("chunk", pa.string(), "string"), ("heading_path", pa.string(), "string"), ("start", pa.int32(), "int"), ("end", pa.int32(), "int"), ("oversized", pa.bool_(), "boolean")]
    return B.per_row(table(spark, folder, "documents", spread=True), "doc_id", "text", B.chunks, columns)


def review_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews by kind and title, also where the header follows other text on its line; kinds, in any case, that aren't known become ``confirm``."""
    pattern = r"(?m)---REVIEW: *(\w[\w\-]*) *\| *([^\n]*?) *---$"
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all("text", F.lit(pattern), F.lit(2)).alias("title"))
    rows = table(spark, folder, "documents", spread=True).select("doc_id", F.explode(found).alias("r"))
    kind = F.lower("r.kind")
    known = F.when(kind.isin("contradiction", "duplicate", "missing-page", "suggestion", "confirm"), kind).otherwise("confirm")
    return rows.groupBy(known.alias("kind"), F.lower("r.title").alias("title")).agg(F.count("*").alias("times"), F.countDistinct("doc_id").alias("docs"))


def audit_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Audit events inside documents, by category: the action up to its dot; lines that begin like one but are no JSON are bad."""
    lines = table(spark, folder, "documents", spread=True).select("doc_id", F.explode(F.split("text", r"\n")).alias("raw")).where(F.col("raw").startswith('{"schemaVersion"'))
    parsed = parsed_lines(lines, "raw")
    action = F.try_variant_get("parsed", "$.action", "string")
    return parsed.groupBy(F.when(F.col("bad"), "bad").otherwise(F.substring_index(action, ".", 1)).alias("category")).agg(F.count("*").alias("events"), F.countDistinct("doc_id").alias("docs"))


QUERIES = {f.__name__: f for f in (file_blocks, chunk_documents, review_blocks, audit_lines)}

SQL = {
    "review_blocks": r"""SELECT CASE WHEN k IN ('contradiction', 'duplicate', 'missing-page', 'suggestion', 'confirm') THEN k ELSE 'confirm' END AS kind, lower(t) AS title, count(*) AS times, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, lower(unnest(regexp_extract_all(text, '(?m)---REVIEW: *(\w[\w\-]*) *\| *([^\n]*?) *---$', 1))) AS k, unnest(regexp_extract_all(text, '(?m)---REVIEW: *(\w[\w\-]*) *\| *([^\n]*?) *---$', 2)) AS t FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2""",
    "audit_lines": """SELECT CASE WHEN NOT json_valid(raw) THEN 'bad' ELSE split_part(json_extract_string(raw, '$.action'), '.', 1) END AS category, count(*) AS events, count(DISTINCT doc_id) AS docs FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents WHERE text IS NOT NULL) WHERE starts_with(raw, '{"schemaVersion"') GROUP BY 1""",
}
