"""Structured Streaming: scoring into the audit log, and windowed monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def start_audit(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every audit row of a stream, however late it comes.

    The file sink commits each micro-batch once, so a restart repeats no row.
    """
    return (
        rows.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def windowed(
    df: DataFrame,
    time: str,
    keys: list[str],
    measures: dict,
    width: str = "1 day",
    delay: str = "1 hour",
) -> DataFrame:
    """Tumbling windows per key; on a stream, rows older than the watermark are left out."""
    timed = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    grouped = timed.groupBy(F.window(time, width), *keys)
    summed = grouped.agg(*[column.alias(name) for name, column in measures.items()])
    return summed.select("window.start", "window.end", *keys, *measures)


def open_windows(stored: DataFrame, history: DataFrame, time: str, keys: list[str], measures: dict, width: str = "1 day") -> DataFrame:
    """The windows a stream over ``history`` still holds open, from one batch pass over the rows behind its last closed one."""
    closed = stored.agg(F.max("end").cast("timestamp")).first()[0]
    rest = history if closed is None else history.filter(F.col(time).cast("timestamp") >= F.lit(closed))
    return windowed(rest, time, keys, measures, width)


def start_windows(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every window once it is closed."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
