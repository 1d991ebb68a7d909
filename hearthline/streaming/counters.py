"""Usage counters as a stream: late events count until the watermark passes their day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, at: str = "ts", key: str = "event_type", late: str = "1 day") -> DataFrame:
    """day, key, n. events: a stream or a table."""
    events = events.withColumn(at, F.col(at).cast("timestamp"))  # a watermark needs a time with a zone: the session's
    counted = events.withWatermark(at, late).groupBy(F.window(at, "1 day"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), "key", "n")


def run_available(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts what has arrived and ends; days become final and are appended once the watermark has passed them."""
    query = counts.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
