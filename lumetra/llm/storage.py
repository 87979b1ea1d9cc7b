"""Where intermediate tables go: the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one where the setting is absent and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lumetra-")
    return _OWN[app]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    The table cuts the lineage, survives the loss of any executor, and keeps column pruning, which a
    serialised RDD checkpoint would lose.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumetra/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables written inside are deleted at the end, but those of the frames put on the list that this gives.

    The shuffle files of what was worked out inside go as well: Spark deletes them once nothing refers to them,
    which a collection of the driver's garbage lets it notice.
    """
    start, keep = len(_WRITTEN), []
    yield keep
    kept = {df.table_path for df in keep}
    gone = [p for p in _WRITTEN[start:] if p not in kept]
    _WRITTEN[start:] = [p for p in _WRITTEN[start:] if p in kept]
    _delete(spark, gone)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cleanup(spark: SparkSession) -> int:
    """Delete the tables that ``materialise`` wrote in this process; call it once results are stored."""
    done = _delete(spark, _WRITTEN)
    _WRITTEN.clear()
    return done
