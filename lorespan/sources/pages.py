"""Folders of Markdown pages as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``page_id`` (file stem), ``path``, ``file_name``, ``content`` of every matching file below a folder; hidden files are skipped."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    path = F.col("_metadata.file_path")
    name = F.url_decode(F.regexp_replace(path, r"^.*/", ""))
    return files.select(F.regexp_replace(name, r"\.md$", "").alias("page_id"), path.alias("path"), name.alias("file_name"), F.col("value").alias("content"))


def write_pages(pages: DataFrame, folder: str, per_file: int = 100_000) -> None:
    """Pages as Parquet, by type; the other way round is :func:`read_pages`."""
    pages.write.mode("append").option("maxRecordsPerFile", per_file).parquet(folder)


def related_pages(pages: DataFrame, source_file: str) -> DataFrame:
    """Pages made from a source file: named in their ``sources``, or a summary whose name begins with the file's stem."""
    stem = source_file.rsplit(".", 1)[0].lower()
    block = F.lower(F.regexp_extract("content", r"(?s)\nsources:([^\n]*(?:\n[ \t]*-[^\n]*)*)", 1))
    named = F.contains(block, F.lit(source_file.lower()))
    summary = F.contains("path", F.lit("/sources/")) & F.lower("page_id").startswith(stem)
    return pages.where((named | summary) & ~F.col("page_id").isin("index", "log", "overview"))
