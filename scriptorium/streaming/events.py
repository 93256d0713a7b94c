"""Streaming over event logs: the same transformations serve batch frames and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import EVENTS


def hourly_counts(events: DataFrame, *, lateness: str = "2 hours") -> DataFrame:
    """Events and their total per hour and type; on a stream, hours close once the watermark has passed them."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    got = rows.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def user_sessions(events: DataFrame, *, gap: str = "30 minutes", lateness: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    got = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return got.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "events")


def first_of_key(events: DataFrame, keys: list[str], *, lateness: str = "2 hours") -> DataFrame:
    """Each key's event once, however often it is delivered within the lateness."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def read_event_log(spark: SparkSession, path: str, *, stream: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """The append-only event log (JSON lines) as a frame or a stream."""
    if stream:
        return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return spark.read.schema(EVENTS).json(path)


def append_events(rows: DataFrame, path: str) -> None:
    rows.select("ts", "event_type", "phase", "stage", "payload").write.mode("append").json(path)


def run_available(stream: DataFrame, *, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what is there, exactly once, into parquet files; a later call goes on from there."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def stop_requested(spark: SparkSession, run_dir: str) -> bool:
    """Whether the flag file STOP stands in a run's folder; asked between actions."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{run_dir}/STOP")
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
