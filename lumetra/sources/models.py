"""Fitted models on disk: versioned folders of Parquet tables that any session can load.

A version is one folder, ``<root>/<name>/version=<n>``: one Parquet table a part, and ``meta`` (key, value) written
last, with the number of rows of every part. A folder without ``meta`` is the rest of a broken save and no version;
``load`` checks the counts, so a part that was cut or changed is an error and not a wrong score. Nothing is ever
overwritten: a save takes the next number.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

FORMAT = 1


def _list(spark: SparkSession, folder: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _numbers(spark: SparkSession, root: str, name: str) -> list[int]:
    return sorted(int(m[1]) for x in _list(spark, f"{root}/{name}") if (m := re.fullmatch(r"version=(\d+)", x)))


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Numbers of the versions that were saved whole."""
    return [n for n in _numbers(spark, root, name) if "_SUCCESS" in _list(spark, f"{root}/{name}/version={n}/meta")]


def save(root: str, name: str, parts: dict[str, DataFrame], meta: dict | None = None) -> int:
    """Write ``parts`` and ``meta`` (values JSON can hold) as the next version; its number."""
    spark = next(iter(parts.values())).sparkSession
    number = max(_numbers(spark, root, name), default=0) + 1
    folder = f"{root}/{name}/version={number}"
    rows, schemas = {}, {}
    for part, df in parts.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{part}")
        rows[part], schemas[part] = spark.read.schema(df.schema).parquet(f"{folder}/{part}").count(), df.schema.json()
    about = {"format": FORMAT, "rows": rows, "schemas": schemas, "meta": meta or {}}
    spark.createDataFrame([(k, json.dumps(v)) for k, v in about.items()], "key string, value string").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/meta")
    return number


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> tuple[dict[str, DataFrame], dict]:
    """(parts, meta) of a version, the last whole one by default."""
    from pyspark.sql.types import StructType

    known = versions(spark, root, name)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no whole version {version or ''} of {name} under {root}")
    folder = f"{root}/{name}/version={known[-1] if version is None else version}"
    about = {r.key: json.loads(r.value) for r in spark.read.schema("key string, value string").parquet(f"{folder}/meta").collect()}
    if about["format"] != FORMAT:
        raise ValueError(f"{folder} has format {about['format']}, this is {FORMAT}")
    parts = {}
    for part, expected in about["rows"].items():
        parts[part] = spark.read.schema(StructType.fromJson(json.loads(about["schemas"][part]))).parquet(f"{folder}/{part}")
        if (held := parts[part].count()) != expected:
            raise OSError(f"{folder}/{part} holds {held} of {expected} rows")
    return parts, about["meta"]
