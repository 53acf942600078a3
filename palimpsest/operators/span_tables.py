"""Masking from spans in rows: what any recogniser, table or model has written down, with keys that lead to the texts.

A row of spans has keys, start and end (bytes), score, ord (the order of recognition) and type_id; source may be missing.
Everything up to the choice of spans is windows over narrow rows; texts meet their spans once, as one sorted array a key.

Keys that are null are equal. Texts without spans stay as they are; spans without a text, beyond it, empty or of no known kind
are passed over. Repeated spans count once, and texts that share a key share its spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.entities import ENTITIES
from palimpsest.functions.spans import SPAN
from palimpsest.operators.intervals import normalized_table
from palimpsest.operators.masking import Options, fresh, is_enabled, rewritten, type_name, unclaimed


def sanitized_table(texts: DataFrame, spans: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Spans within their texts and of known kinds. Of the texts only lengths are moved."""
    size = fresh(spans, "text_size")
    sizes = texts.groupBy(*keys).agg(F.max(F.octet_length(text_col)).alias(size))
    ours, theirs = spans.alias("s"), sizes.alias("t")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}"))
    inside = (F.col("s.start") >= 0) & (F.col("s.start") < F.col("s.end")) & (F.col("s.end") <= F.col(f"t.{size}"))
    return ours.join(theirs, same).where(inside & F.col("s.type_id").between(1, len(ENTITIES))).select("s.*")


def dedup_table(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of spans of one range the one of the highest score, of those the first recognised."""
    rank = fresh(spans, "span_rank")
    best = Window.partitionBy(*keys, "start", "end").orderBy(F.desc("score"), "ord")
    return spans.withColumn(rank, F.row_number().over(best)).where(F.col(rank) == 1).drop(rank)


def item_table(texts: DataFrame, spans: DataFrame, keys: list[str], text_col: str = "text", options: Options | None = None) -> DataFrame:
    """(keys, id, type_id, type, start, end, score): what masking replaces, numbered by start in each text."""
    options = options or Options()
    if "source" not in spans.columns:
        spans = spans.withColumn("source", F.lit("table"))
    kept = normalized_table(sanitized_table(texts, spans, keys, text_col), keys, options.min_score).where(is_enabled(F.col("type_id"), options.switches))
    serial = F.row_number().over(Window.partitionBy(*keys).orderBy("start")).cast("bigint")
    return kept.select(*keys, serial.alias("id"), F.col("type_id").cast("tinyint").alias("type_id"), type_name(F.col("type_id")).alias("type"), "start", "end", "score", "ord", "source")


def mask_from_spans(texts: DataFrame, spans: DataFrame, keys: list[str], text_col: str = "text", options: Options | None = None, masked_col: str = "masked", meta_col: str = "meta") -> DataFrame:
    """texts with masked and meta (original, items), as mask_frame makes them of spans that it finds itself."""
    unclaimed(texts, masked_col, meta_col)
    items = item_table(texts, spans, keys, text_col, options)
    found, made = fresh(texts, "found_spans"), fresh(texts, "made_of_spans")
    one = F.struct("start", "end", "score", "ord", "type_id", "source")
    arrays = items.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).cast(f"array<{SPAN}>").alias(found)).alias("s")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
    joined = texts.alias("t").join(arrays, same, "left").select("t.*", F.coalesce(F.col(f"s.{found}"), F.array().cast(f"array<{SPAN}>")).alias(found))
    # A generator of one row keeps the expression whole: no later projection computes it again.
    out = joined.select("*", F.explode_outer(F.array(rewritten(F.col(text_col), F.col(found)))).alias(made))
    meta = F.struct(F.col(text_col).alias("original"), F.col(f"{made}.items").alias("items"))
    return out.withColumn(masked_col, F.col(f"{made}.masked")).withColumn(meta_col, meta).drop(found, made)
