"""Restoring on streams: replies meet the credentials of what was asked, whichever comes first.

A credential is good for replies of the `reach` after it. Both streams carry event times and watermarks: credentials leave the state
once no reply can want them any more, and a reply whose credential does not come by then goes out as it is, with `found` false. Of
credentials of one key within the watermark the first counts. A reply that comes later than `delay` behind the newest one is not
looked at by the stream; left_out() finds these, and the same function restores them as a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.masking import fresh, restored, unclaimed


def restore_replies(
    replies: DataFrame, credentials: DataFrame, key: str, reply_time: str = "replied_at", credential_time: str = "masked_at",
    reach: str = "1 day", delay: str = "1 hour", reply_col: str = "reply", meta_col: str = "meta", restored_col: str = "restored", found_col: str = "found",
) -> DataFrame:
    """replies with restored and found, of two streams or two tables; streams need append mode.

    Null keys and null times find nothing; other columns of credentials are left out.
    """
    unclaimed(replies, restored_col, found_col)
    streams = replies.isStreaming and credentials.isStreaming
    name, held, at = fresh(replies, "credential_key"), fresh(replies, "credential_meta"), fresh(replies, "credential_time")
    known = credentials.select(F.col(key).alias(name), F.col(meta_col).alias(held), F.col(credential_time).alias(at)).where(F.col(at).isNotNull())
    if streams:
        known = known.withWatermark(at, delay).dropDuplicatesWithinWatermark([name])
        replies = replies.withWatermark(reply_time, delay)
    else:
        known = known.groupBy(name).agg(F.min_by(F.struct(held), at).alias(held), F.min(at).alias(at)).select(name, f"{held}.{held}", at)
    within = (F.col(at) <= F.col(reply_time)) & (F.col(at) >= F.col(reply_time) - F.expr(f"INTERVAL {reach}"))
    joined = replies.join(known, (F.col(key) == F.col(name)) & within, "left")
    out = joined.withColumn(found_col, F.col(name).isNotNull())
    return out.withColumn(restored_col, restored(F.col(reply_col), F.col(f"{held}.original"), F.col(f"{held}.items"))).drop(name, held, at)


def start_restoring(replies: DataFrame, credentials: DataFrame, key: str, path: str, checkpoint: str, trigger: dict | None = None, **how) -> StreamingQuery:
    """Appends restored replies to a folder. Restarted with the same checkpoint, it goes on where it stopped."""
    made = restore_replies(replies, credentials, key, **how)
    return made.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def left_out(replies: DataFrame, done: DataFrame, ids: list[str]) -> DataFrame:
    """Replies that the stream's result does not hold: those that came too late for it, or wait in its state. ids tell replies apart."""
    same = F.lit(True)
    for i in ids:
        same = same & F.col(f"r.{i}").eqNullSafe(F.col(f"d.{i}"))
    return replies.alias("r").join(done.select(*ids).distinct().alias("d"), same, "left_anti")
