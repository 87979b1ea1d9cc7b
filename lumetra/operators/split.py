"""Deterministic stratified splits and the removals that keep splits apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def ranked(rows: DataFrame, label: str, key: str, hashed: Column) -> DataFrame:
    """``rows`` with __r, their rank from 1 in the label's order of ``hashed`` (hexadecimal digits), and __n, the label's number of rows.

    Ranks are counted inside 4,096 ranges of the hash and start from the counts of the ranges before, so no task
    sorts all rows of a label. A null key has a null hash and comes first; a null label is a label.
    """
    hashed = rows.withColumn("__h", hashed).withColumn("__b", F.coalesce(F.substring("__h", 1, 3), F.lit("")))
    w = Window.partitionBy("__label")
    counts = hashed.groupBy(F.col(label).alias("__label"), F.col("__b").alias("__range")).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(w.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__label", "__range", before.alias("__before"), F.sum("__c").over(w).alias("__n"))
    dealt = hashed.join(counts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__b") == F.col("__range")))
    inside = F.row_number().over(Window.partitionBy("__label", "__range").orderBy("__h", key))
    return dealt.withColumn("__r", inside + F.col("__before")).drop("__h", "__b", "__label", "__range", "__before")


def stratified_split(rows: DataFrame, label: str, key: str, parts: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """``split`` by rank in the label's hash order; the last part takes what rounding leaves."""
    placed = ranked(rows, label, key, hash_order(seed, F.col(key)))
    out, total = None, 0.0
    for name, share in parts[:-1]:
        total += share
        hit = F.col("__r") <= F.floor(F.col("__n") * F.lit(round(total, 9)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return placed.withColumn("split", out.otherwise(parts[-1][0])).drop("__r", "__n")


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` from 0 in turn by rank in the label's hash order."""
    return ranked(rows, label, key, hash_order(seed, F.col(key))).withColumn("fold", ((F.col("__r") - 1) % folds).cast("int")).drop("__r", "__n")


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes * n of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def without_shared_keys(rows: DataFrame, other: DataFrame, key: Column, name: str = "__key") -> DataFrame:
    """Rows whose non-empty key is not among the other side's."""
    mine = rows.withColumn(name, F.when(F.coalesce(key, F.lit("")) != "", key))
    theirs = other.select(key.alias(name)).where(F.coalesce(F.col(name), F.lit("")) != "").distinct()
    return mine.join(theirs, name, "left_anti").drop(name)


def shared_keys(rows: DataFrame, other: DataFrame, key: Column) -> DataFrame:
    """Distinct keys that both sides have."""
    return rows.select(key.alias("key")).intersect(other.select(key.alias("key")))
