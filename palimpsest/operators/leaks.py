"""Leaks: values that masking replaced in one text and that still stand in another masked one.

Rules look at what is around a value, so that a password is masked behind its label and left alone elsewhere. The audit takes each
distinct masked value, and of its words the one that the fewest masked texts hold; texts that hold that word are candidates, and each
is searched for the whole value. A value stands in a text where it is no part of a longer word.

Masking runs once: masked texts and the values in them are written to the shared scratch folder, and so are the places of wanted
words. Texts are moved once, for the last step, and only those with a candidate; all else is words and keys. No two texts or values
are compared with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.rules import WORD
from palimpsest.functions.spans import bind, slice_of
from palimpsest.operators.masking import fresh, unclaimed
from palimpsest.sources.scratch import scratch_folder

_WORDS = f"[{WORD}]+"


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORDS), F.lit(0)))


def _items(meta_col: str) -> Column:
    """(type, value) of the items of a row's meta."""
    held = lambda data: F.transform(F.col(f"{meta_col}.items"), lambda i: F.struct(i["type"].alias("type"), slice_of(data, i["start"], i["end"] - i["start"]).alias("value")))
    return bind(F.col(f"{meta_col}.original").cast("binary"), held)


def masked_values(masks: DataFrame, meta_col: str = "meta", min_chars: int = 4) -> DataFrame:
    """(type, value, n_items) of distinct masked values of at least min_chars characters."""
    # One generator row, then the condition: an inner explode would have the optimizer find all items twice.
    return _distinct(masks.select(F.explode_outer(_items(meta_col)).alias("i")), min_chars)


def _distinct(rows: DataFrame, min_chars: int) -> DataFrame:
    items = rows.where("i IS NOT NULL").select("i.*")
    return items.where(F.char_length("value") >= min_chars).groupBy("type", "value").agg(F.count(F.lit(1)).alias("n_items"))


def _written(df: DataFrame, what: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stands(text: Column, value: Column) -> Column:
    """Whether the value is in the text, and not within a longer word."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    edge = f"(?:(?<![{WORD}])|(?![{WORD}]))", f"(?:(?![{WORD}])|(?<![{WORD}]))"
    return F.contains(text, value) & F.regexp_like(text, F.concat(F.lit(edge[0]), quoted, F.lit(edge[1])))


def leaks(masks: DataFrame, keys: list[str], masked_col: str = "masked", meta_col: str = "meta", min_chars: int = 4) -> DataFrame:
    """(keys, type, value, n_items) for each masked text and each value that stands in it; n_items: how often the value was masked.

    Keys tell texts apart; texts without a key, null texts and values without a word are passed over.
    """
    unclaimed(masks.select(*keys), "type", "value", "n_items", "word", "n_texts")
    items = fresh(masks, "leak_items")
    written = _written(masks.select(*keys, masked_col, _items(meta_col).alias(items)), "masks")
    named = written.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    values = _written(_distinct(written.select(F.explode_outer(items).alias("i")), min_chars), "values").select("*", F.explode(words(F.col("value"))).alias("word"))
    wanted = values.select("word").distinct()
    places = _written(named.select(*keys, F.explode(words(F.col(masked_col))).alias("word")).join(wanted, "word", "left_semi"), "places")
    often = places.groupBy("word").agg(F.count(F.lit(1)).alias("n_texts"))
    # A word that no masked text holds tells that its value stands nowhere: an inner join would take another word instead.
    rarest = F.row_number().over(Window.partitionBy("type", "value").orderBy(F.coalesce("n_texts", F.lit(0)), "word"))
    seeds = values.join(often, "word", "left").withColumn("rank", rarest).where("rank = 1 AND n_texts > 0").select("word", "type", "value", "n_items")
    near = places.join(seeds, "word").drop("word")
    return named.select(*keys, masked_col).join(near, keys).where(stands(F.col(masked_col), F.col("value"))).select(*keys, "type", "value", "n_items").distinct()
