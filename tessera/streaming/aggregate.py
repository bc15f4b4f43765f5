"""The grouped aggregate over a stream: an extension, with event-time windows and late data cut off by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def stream_key_aggregate(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, cnt, sum, sumsq) so far; for update and complete output. Squares are taken in double."""
    v = F.col(value).cast("double")
    return stream.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("cnt"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq"))


def stream_window_aggregate(stream: DataFrame, key: str, value: str, ts: str, width: str, late: str) -> DataFrame:
    """(start, key, cnt, sum, sumsq) for each window of the given width, final once the watermark passes; for append output."""
    v = F.col(value).cast("double")
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key).alias("key"))
    return rows.agg(F.count("*").alias("cnt"), F.sum(v).alias("sum"), F.sum(v * v).alias("sumsq")).select(F.col("w.start").alias("start"), "key", "cnt", "sum", "sumsq")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """An append stream of rows to Parquet, exactly once by its checkpoint, over what is there now."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
