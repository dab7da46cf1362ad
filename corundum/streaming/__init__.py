"""Structured Streaming over event tables: windows, sessions and deduplication with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(events: DataFrame, width: str, by: list[str], slide: str | None = None, ts: str = "ts", value: str = "value", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling (or sliding) window and key; works on streams and on tables.

    An event without a time is in no window.
    """
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = _timed(events, ts, late).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap without events; an event without a time is in none."""
    out = _timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("s"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def once(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each key once; state older than the watermark is dropped."""
    return _timed(events, ts, late).dropDuplicatesWithinWatermark([key])


def into_table(stream: DataFrame, engine, table: str, checkpoint: str, name: str | None = None):
    """Appends a stream to a table of an engine, one commit a batch.

    The number of the last batch is committed with its rows under ``name`` (the
    checkpoint's folder, if there is none), so a batch that is repeated after a
    failure is not appended twice.
    """
    of = name or checkpoint
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: engine.insert(table, batch, batch=(of, n))).trigger(availableNow=True).start()
