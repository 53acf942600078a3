"""Counts over event time: tumbling, sliding and session windows of events or of masked items.

windowed_counts and session_counts are declarative, on tables and on streams; there, a window comes out once the watermark has passed it,
and rows that are later than `delay` are not counted. start_counting loses no row however late: each batch adds its own partial
counts, under its number, and counted() adds them up. A batch that is run again replaces its own part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _counted(rows: DataFrame, window: Column, keys: list[str], more: list[Column]) -> DataFrame:
    out = rows.groupBy(window.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"), *more)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def _timed(rows: DataFrame, time_col: str, delay: str) -> DataFrame:
    return rows.withWatermark(time_col, delay) if rows.isStreaming else rows


def windowed_counts(rows: DataFrame, time_col: str, keys: list[str], width: str, slide: str | None = None, delay: str = "1 hour", more: list[Column] | None = None) -> DataFrame:
    """(window_start, window_end, keys, n, more) of rows by event time; more: further aggregates. Rows without time are in no window."""
    return _counted(_timed(rows, time_col, delay), F.window(time_col, width, slide), keys, more or [])


def session_counts(rows: DataFrame, time_col: str, keys: list[str], gap: str, delay: str = "1 hour", more: list[Column] | None = None) -> DataFrame:
    """The same by session: rows of a key less than `gap` after the last one are one window, which ends `gap` after its last row."""
    return _counted(_timed(rows, time_col, delay), F.session_window(time_col, gap), keys, more or [])


def start_counting(stream: DataFrame, time_col: str, keys: list[str], path: str, checkpoint: str, width: str, slide: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Writes partial counts of each batch. Stateless: neither watermark nor state, so that no row is too late."""

    def write(batch: DataFrame, number: int) -> None:
        windowed_counts(batch, time_col, keys, width, slide).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counted(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts over all batches: windows and keys add up."""
    return parts.groupBy("window_start", "window_end", *keys).agg(F.sum("n").alias("n"))
