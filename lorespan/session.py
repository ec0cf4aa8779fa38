"""What every operator needs of the session: tables, and a place for results that cut a plan's lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, spread: bool = False) -> DataFrame:
    """One input table, a Parquet file or folder ``{folder}/{name}.parquet``.

    With ``spread``, for work that is heavy per row, a table whose scan has fewer tasks than the session has cores is spread
    over all of them.  A task reads up to ``spark.sql.files.maxPartitionBytes``, so what is moved is less than that for each
    core; any larger table is read where it is.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if spread and rows.rdd.getNumPartitions() < cores else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, as in tests on one machine, a temporary folder may take its place; elsewhere executors would each
    write to their own disk, so a cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="lorespan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed when the driver ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/lorespan-{context.applicationId}"
    if getattr(context, "_lorespan_folder", None) != folder:
        context._lorespan_folder = folder
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:  # the session was stopped before
        return
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    It cuts the lineage of iterative jobs, is computed once however often it is read, and outlives its executors.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    step = spark.read.schema(df.schema).parquet(path)
    step._lorespan_path = path
    return step


def discard(*steps: DataFrame) -> None:
    """Delete the tables of :func:`written` that nothing will read any more."""
    for step in steps:
        _remove(step.sparkSession, step._lorespan_path)


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> tuple[DataFrame, int]:
    """``df`` with the place of each row in an order, from 1, and the number of rows.

    The rows are split into ranges of the order, numbered in each range and moved by the sizes of those before, so no task
    holds them all.  The order must be total.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    rows = written(split, "ranges")  # a range must not change between its two uses
    sizes = sorted((r["_range"], r["n"]) for r in rows.groupBy("_range").agg(F.count("*").alias("n")).collect())  # one row for each range
    total, before = 0, []
    for number, n in sizes:
        before.append((number, total))
        total += n
    moved = spark.createDataFrame(before, "_range int, _before long")
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    placed = rows.withColumn("_own", own).join(F.broadcast(moved), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_before", "_own"), total


def tokenizer_path(file: str = "byte_bpe_50k.tiktoken") -> str:
    """Path of a public tokenizer's vocabulary; the folder is the parameter ``LORESPAN_TOKENIZERS``."""
    return os.path.join(os.environ.get("LORESPAN_TOKENIZERS", "/opt/tokenizers"), file)
