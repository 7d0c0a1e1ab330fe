"""Passages per key and window as a stream, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_passages(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(finestra, key, passaggi, prima, ultima) of a streaming or batch frame; rows later than ``late`` are left out of a stream."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    each = timed.groupBy(F.window(time, window), key).agg(F.count("*").alias("passaggi"), F.min(time).alias("prima"), F.max(time).alias("ultima"))
    return each.select(F.col("window.start").alias("finestra"), key, "passaggi", "prima", "ultima")


def run_to_end(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All rows of a stream that is read once to its end, from a table in memory; for bounded inputs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
