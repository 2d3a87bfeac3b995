"""New events against known series as they arrive, an extension of the batch matchers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_stream(events: DataFrame, series: DataFrame) -> DataFrame:
    """A stream of events (id, text) joined with a static table of series (id, text) on equal titles."""
    known = series.select(F.col("id").alias("series"), "text").dropDuplicates(["text"])
    return events.join(known, "text").select(F.col("id").alias("event"), "series")


def counted_by_type(events: DataFrame, time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, type, n) of a stream of typed events; later ones than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), "type").agg(F.count("*").alias("n"))


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch of matches to a Parquet log, once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
