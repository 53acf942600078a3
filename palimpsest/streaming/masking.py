"""Masking of streams: the same expressions on unbounded input, and the credentials to a sink of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.masking import Options, mask_frame


def mask_stream(stream: DataFrame, text_col: str = "text", options: Options | None = None) -> DataFrame:
    """A streaming DataFrame with masked and meta. Stateless: no watermark, no shuffle."""
    return mask_frame(stream, text_col, options)


def start_masking(stream: DataFrame, key: str, masked_path: str, meta_path: str, checkpoint: str, text_col: str = "text", options: Options | None = None, **trigger) -> StreamingQuery:
    """Writes (key, masked) and (key, meta) of each batch to two folders. A batch that is run again replaces its own part.

    A batch is kept, in memory as far as that goes and on the executors' disks beyond, until both are written; the source's limits,
    such as maxFilesPerTrigger, bound it.
    """
    made = mask_frame(stream, text_col, options).select(key, "masked", "meta")

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            batch.select(key, "masked").write.mode("overwrite").parquet(f"{masked_path}/batch={number}")
            batch.select(key, "meta").write.mode("overwrite").parquet(f"{meta_path}/batch={number}")
        finally:
            batch.unpersist()

    return made.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
