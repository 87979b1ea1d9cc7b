"""Structured Streaming: trigger messages, keyed deduplication and windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table_stream

TRIGGER = "data_source string, url string, entity_type string, start_date date, end_date date, parameters struct<portal: string, page_1_url: string>"


def parse_triggers(messages: DataFrame) -> DataFrame:
    """Crawl triggers from a ``value`` column; a message that breaks the schema stops the query."""
    return messages.select(F.from_json(F.col("value").cast("string"), TRIGGER, {"mode": "FAILFAST"}).alias("m")).select("m.*")


def judged_triggers(messages: DataFrame) -> DataFrame:
    """``messages`` with m, the parsed trigger, and reason: null for a good message, else why it can't be used.

    A message must be a JSON object that fits the schema and names a URL and a portal or a folder; dates must be dates.
    """
    text = F.col("value").cast("string")
    m = F.from_json(text, f"{TRIGGER}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    own = messages.withColumn("m", m)
    reason = F.when(text.isNull() | (F.trim(text) == ""), "empty").when(F.col("m").isNull() | F.col("m.broken").isNotNull(), "schema")
    reason = reason.when(F.coalesce(F.trim("m.url"), F.lit("")) == "", "no url").when(F.col("m.end_date") < F.col("m.start_date"), "dates")
    return own.withColumn("reason", reason).withColumn("m", F.col("m").dropFields("broken"))


def run_with_quarantine(messages: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Drain a stream of messages into two tables in one query: good triggers, and the others with their reason.

    Each micro-batch overwrites its own partition of both tables, so one that is done anew is not doubled; a message
    that can't be used never ends the stream.
    """
    judged = judged_triggers(messages)

    def both(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        held.where("reason IS NULL").select("m.*").write.mode("overwrite").parquet(f"{folder}/good/batch={number}")
        held.where("reason IS NOT NULL").select(F.col("value").cast("string").alias("value"), "reason").write.mode("overwrite").parquet(f"{folder}/quarantine/batch={number}")
        held.unpersist()

    query = judged.writeStream.foreachBatch(both).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = messages.sparkSession
    read = lambda name, schema: spark.read.schema(schema).option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return read("good", TRIGGER), read("quarantine", "value string, reason string")


def route(triggers: DataFrame) -> DataFrame:
    """Where a message goes: a folder, a whole portal, or a dated crawl."""
    return triggers.withColumn("route", F.when(F.col("url").rlike("^[^:]+/"), "folder").when(F.col("start_date").isNull(), "collect_all").otherwise("dated"))


def events_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream; ``ts`` becomes a timestamp for watermarks.

    Files of a stored table are in no order of time, so they are one micro-batch unless ``files_per_trigger`` parts them:
    the watermark of one file would refuse the rows of the next.
    """
    return table_stream(spark, sf_dir, "events", files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def first_of_key(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen inside the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum by window and type."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(stream: DataFrame, width: str = "1 day", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Count and sum by overlapping window and type: each event is in width / step windows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Each user's sessions: events less than ``gap`` apart; start, end (gap after the last event), events and sum."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def followed_within(first: DataFrame, then: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Pairs of one user's events, ``then`` at most ``within`` after ``first``: an interval join of two streams.

    Both sides have a watermark, so state older than the interval is dropped. ``first`` and ``then`` have event_id,
    user_id and ts.
    """
    a = first.select(F.col("event_id").alias("first_id"), F.col("user_id").alias("first_user"), F.col("ts").alias("first_ts")).withWatermark("first_ts", late)
    b = then.select(F.col("event_id").alias("then_id"), "user_id", F.col("ts").alias("then_ts")).withWatermark("then_ts", late)
    near = (F.col("first_user") == F.col("user_id")) & (F.col("then_ts") >= F.col("first_ts")) & (F.col("then_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, near).select("user_id", "first_id", "then_id", "first_ts", "then_ts")


def run_counting_late(stream: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """``run_once`` and the rows that windows refused because the watermark had passed them."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table").trigger(availableNow=True).start()
    query.awaitTermination()
    # one entry a micro-batch of this run, of the last hundred that Spark keeps
    late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table"), late


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Drain what the source holds into a Parquet table, exactly once, and return the table.

    The checkpoint beside the table makes a rerun continue where a lost one stopped.
    """
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/table").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")
