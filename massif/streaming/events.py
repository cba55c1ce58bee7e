"""Structured Streaming counterparts of scan windows and gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, with `ts` as a timestamp."""
    df = spark.readStream.schema(schema).parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def sliding_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    """(start, event_type, n, total) of overlapping windows; events later than the watermark are left out."""
    keyed = events.withWatermark("ts", late) if events.isStreaming else events
    out = keyed.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def gap_sessions(events: DataFrame, late: str = "10 minutes", gap: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n) of runs of events without a gap: a trace closes when its gap has passed."""
    keyed = events.withWatermark("ts", late) if events.isStreaming else events
    out = keyed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_to_memory(stream: DataFrame, name: str) -> DataFrame:
    """All rows of a stream over what is there now; the query ends by itself."""
    q = stream.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
