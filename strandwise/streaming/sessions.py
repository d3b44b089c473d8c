"""Streams: gap-merged sessions, tumbling windows and distinct rows by Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import shared_dir


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """user_id, first, last, n of runs of events less than `gap` apart; events later than `late` are left out of streams."""
    if events.isStreaming and late:
        events = events.withWatermark("ts", late)
    return events.groupBy("user_id", F.session_window("ts", gap)).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).drop("session_window")


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = "1 hour") -> DataFrame:
    if events.isStreaming and late:
        events = events.withWatermark("ts", late)
    return events.groupBy("event_type", F.window("ts", width)).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), "n")


def distinct_stream(events: DataFrame, *columns: str, late: str | None = None) -> DataFrame:
    """Distinct rows of `columns`. `late` bounds the state of a stream: a row that comes again later than that comes again."""
    if events.isStreaming and late:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(columns)).select(*columns)
    return events.select(*columns).dropDuplicates(list(columns))


def stream(spark, sf_dir: str) -> DataFrame:
    """The files of `events` as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def run(out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over its source's files to their end, into Parquet files of the shared folder, and reads what it wrote.

    What a watermark still holds when the files end isn't written in append mode: such streams end with a last batch that
    is later than all others, or run in complete mode, whose last batch is the result.
    """
    spark = out.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # each batch has a folder of its own, so a batch that is repeated replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{base}/out/{number:09d}" if mode == "append" else f"{base}/out/last")

    q = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")


def stream_sessions(spark, sf_dir: str) -> DataFrame:
    """Gap-merged sessions of the stream; complete mode, as its result is read at the end."""
    out = run(sessions(stream(spark, sf_dir), late=None), "complete")
    return out.withColumns({k: F.col(k).cast("timestamp_ntz") for k in ("first", "last")})


def stream_windows(spark, sf_dir: str) -> DataFrame:
    return run(tumbling(stream(spark, sf_dir), late=None), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_distinct(spark, sf_dir: str) -> DataFrame:
    return run(distinct_stream(stream(spark, sf_dir), "user_id", "event_type"))


def carry(events: DataFrame, key: str, order: str, value: str, size: int) -> DataFrame:
    """Sliding carry-over: each row with the sum of `value` over it and the size - 1 rows before it of its key."""
    w = Window.partitionBy(key).orderBy(order, "event_id").rowsBetween(1 - size, 0)
    return events.withColumn("carried", F.sum(value).over(w))
