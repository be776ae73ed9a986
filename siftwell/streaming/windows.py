"""Structured Streaming: event-time windows, and a load that resumes and skips what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwell.operators.tables import resume


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Events and their value by window and type. late: how long a stream waits for late events."""
    return _windowed(events, F.window("ts", size), late)


def sliding(events: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    return _windowed(events, F.window("ts", size, step), late)


def _windowed(events: DataFrame, window, late: str | None) -> DataFrame:
    df = events.withWatermark("ts", late) if late else events
    out = df.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Events of each user between pauses of at least gap."""
    df = events.withWatermark("ts", late) if late else events
    out = df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def load_new(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends streamed passages (doc, text, ...) to a Parquet table; those that it holds are skipped in each micro-batch."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["doc", "text"])
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = resume(spark.read.parquet(store), fresh)
        fresh.write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
