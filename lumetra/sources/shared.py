"""Cutting lineage in the shared folder that the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where the session names none and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not named and app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lumetra-checkpoint-")
    return (named or _OWN[app]).rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def materialised(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder: for large results that are read more than once by column."""
    path = f"{shared_dir(df.sparkSession)}/lumetra-tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> int:
    """Delete the tables that ``materialised`` wrote in this process; call it once results are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for name in _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(name)
        done += bool(path.getFileSystem(conf).delete(path, True))
    _WRITTEN.clear()
    return done
