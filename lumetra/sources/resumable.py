"""Batch jobs that continue after a cut: a queue of batches, staged results and a manifest of what is done.

``prepare`` deals the input once into a queue partitioned by batch, by a hash of the key, so each batch is read by
partition pruning and never by another scan. ``process`` does the batches that the manifest lacks: the result of some
batches is staged under a new name, moved into the table by dynamic partition overwrite, and then entered in the
manifest with its rows. A run that dies at any point leaves either nothing that counts or a whole batch, and ``table``
shows only batches that the manifest has. A batch that is done twice, because a run died between table and manifest,
replaces itself.

Defined results: a null key is a key; an empty input is done with no row; a batch without rows is entered with none.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch int, rows long, attempt string"


def _exists(spark: SparkSession, folder: str, name: str = "_SUCCESS") -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def prepare(rows: DataFrame, key: str, folder: str, batches: int) -> None:
    """Write the queue of ``rows`` unless it is there whole."""
    if not _exists(rows.sparkSession, f"{folder}/queue"):
        dealt = rows.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
        dealt.write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/queue")
        plan = rows.sparkSession.range(batches).select(F.col("id").cast("int").alias("batch"))
        plan.write.mode("overwrite").parquet(f"{folder}/plan")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows, attempt) of the batches that are done; one row a batch."""
    if not _exists(spark, f"{folder}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").groupBy("batch").agg(F.max(F.struct("attempt", "rows")).alias("x")).select("batch", "x.rows", "x.attempt")


def pending(spark: SparkSession, folder: str) -> list[int]:
    """Batches of the plan that the manifest lacks: a number each, as many as ``prepare`` was told."""
    plan = spark.read.schema("batch int").parquet(f"{folder}/plan")
    return sorted(r.batch for r in plan.join(manifest(spark, folder), "batch", "left_anti").collect())


def process(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], at_once: int = 1, stop_after: int | None = None) -> int:
    """Do pending batches, ``at_once`` to a commit, and return how many; ``stop_after`` commits end the run early.

    ``work`` gets the rows of some batches with their column ``batch`` and must keep it.
    """
    if not _exists(spark, f"{folder}/plan"):
        raise FileNotFoundError(f"{folder} has no whole queue; call prepare first")
    held = spark.read.parquet(f"{folder}/queue") if _partitions(spark, f"{folder}/queue") else None
    todo = pending(spark, folder)
    for i in range(0, len(todo), at_once):
        if stop_after is not None and i // at_once >= stop_after:
            return i
        own, attempt = todo[i : i + at_once], uuid.uuid4().hex
        if held is not None:
            staged = f"{folder}/staged/{attempt}"
            done = work(held.where(F.col("batch").isin(own)))
            done.write.parquet(staged)
            back = spark.read.schema(done.schema).parquet(staged)
            back.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("batch").parquet(f"{folder}/table")
            counts = {r.batch: r["count"] for r in back.groupBy("batch").count().collect()}  # a row a batch of this commit
        else:
            counts = {}
        entries = spark.createDataFrame([(b, counts.get(b, 0), attempt) for b in own], MANIFEST)
        entries.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")
    return len(todo)


def _partitions(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return any(s.isDirectory() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))


def table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of ``schema`` and batch that finished batches have; batches that were cut don't show."""
    if not _exists(spark, folder, "table"):  # dynamic overwrite leaves no mark of its own
        return spark.createDataFrame([], f"{schema}, batch int")
    held = spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/table")
    return held.join(F.broadcast(manifest(spark, folder).select("batch")), "batch", "left_semi")
