"""Calls of an unreliable service from a stream: bounded attempts, a back-off plan, and a log of every attempt.

Each micro-batch goes through up to ``attempts`` rounds. A round calls the service for what is still open, on the
executors, and writes one row a call: what came back (choice, raw), how long it took by the service's own word, and
whether it failed. Rows that failed wait ``base`` * 2^(attempt - 1) seconds, at most ``most``, and go into the next round;
those that fail in the last one stay as failures. A round reads the log of the round before, never the service again,
so every call is logged once. A micro-batch that is done anew, as after a lost driver, replaces its own partition of
the log.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "key long, attempt int, choice int, raw string, seconds double, failed boolean, waited double"


class Service:
    """What is called for (key, payload): gives (choice, raw, seconds) or raises; the attempt counts from 1."""

    def call(self, key: int, payload: str, attempt: int) -> tuple[int, str, float]:
        raise NotImplementedError


class FailsFirst(Service):
    """A stand-in that refuses each key as often as the key's remainder by ``kinds``, then answers with the payload's length."""

    def __init__(self, kinds: int, seconds: float):
        self.kinds, self.seconds = kinds, seconds

    def call(self, key: int, payload: str, attempt: int) -> tuple[int, str, float]:
        if attempt <= key % self.kinds:
            raise TimeoutError(f"attempt {attempt}")
        return len(payload), payload, attempt * self.seconds


def waits(attempts: int, base: float, most: float) -> list[float]:
    """Seconds before each attempt: none before the first, doubling from ``base`` up to ``most``."""
    return [0.0] + [min(base * 2**i, most) for i in range(attempts - 1)]


def _round(rows: DataFrame, service: Service, attempt: int, waited: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = {"choice": [], "raw": [], "seconds": [], "failed": []}
            for key, payload in zip(batch["key"], batch["payload"], strict=True):
                try:
                    answer = (*service.call(int(key), payload, attempt), False)
                except Exception as error:  # what the service raises is its failure, and is logged as such
                    answer = (-1, f"{type(error).__name__}: {error}", 0.0, True)
                for name, value in zip(out, answer, strict=True):
                    out[name].append(value)
            yield batch.assign(attempt=attempt, waited=waited, **out)[["key", "payload", "attempt", "choice", "raw", "seconds", "failed", "waited"]]

    return rows.mapInPandas(run, "key long, payload string, attempt int, choice int, raw string, seconds double, failed boolean, waited double")


def call_with_retries(rows: DataFrame, service: Service, folder: str, batch: int, attempts: int = 3, base: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """Log every attempt for (key, payload) of one micro-batch under ``folder``, one partition an attempt."""
    spark, open_rows = rows.sparkSession, rows.select("key", "payload")
    for attempt, wait in enumerate(waits(attempts, base, most), 1):
        if wait:
            sleep(wait)
        path = f"{folder}/batch={batch}/round={attempt}"
        done = _round(open_rows, service, attempt, wait)
        done.write.mode("overwrite").parquet(path)
        open_rows = spark.read.schema(done.schema).parquet(path).where("failed").select("key", "payload")
        if open_rows.isEmpty():
            for later in range(attempt + 1, attempts + 1):  # of a run before
                _drop(spark, f"{folder}/batch={batch}/round={later}")
            return


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def attempts_log(spark: SparkSession, folder: str) -> DataFrame:
    """(key, attempt, choice, raw, seconds, failed, waited) of every call."""
    held = spark.read.schema(f"{LOG}, batch int, round int").option("basePath", folder).parquet(folder)
    return held.select(*[c.split(" ")[0] for c in LOG.split(", ")])


def outcomes(log: DataFrame) -> DataFrame:
    """The last attempt of each key: (key, choice, raw, seconds, failed, attempts, waited)."""
    last = log.groupBy("key").agg(F.max_by(F.struct("choice", "raw", "seconds", "failed"), "attempt").alias("x"), F.max("attempt").alias("attempts"), F.sum("waited").alias("waited"))
    return last.select("key", "x.*", "attempts", "waited")


def stream_with_retries(stream: DataFrame, service: Service, folder: str, **plan) -> DataFrame:
    """Drain a stream of (key, payload) through ``service``; the log of attempts."""

    def each(batch: DataFrame, number: int) -> None:
        call_with_retries(batch, service, f"{folder}/log", number, **plan)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return attempts_log(stream.sparkSession, f"{folder}/log")
