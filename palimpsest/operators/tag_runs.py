"""Runs of tagged tokens as entities: gaps and islands over a table of tokens, windows only.

A token is (keys, place, start, end, type, opens, joined, score): type is null where a token is of no kind, opens says that its tag
begins an entity, joined that its text goes on with the word before it. An entity opens at an opening token and takes the
tokens of its type that follow without a gap, up to the next one that opens and is not joined; tokens before the first opening
one of a stretch belong to none. The score is halved with each token: (score so far + the token's) / 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def entities(tokens: DataFrame, keys: list[str], dense: bool = False) -> DataFrame:
    """(keys, type, start, end, score, n_tokens) of each entity. Null opens and joined are false.

    dense: places of a key count up by one, so that a gap tells of tokens of no kind: these, mostly the greater part, are never moved.
    """
    order = Window.partitionBy(*keys).orderBy("place")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    breaks = ~F.col("type").eqNullSafe(F.lag("type").over(order))
    if dense:
        tokens = tokens.where("type IS NOT NULL")
        breaks = breaks | (F.col("place") - F.lag("place").over(order) > 1)
    rows = tokens.select(*keys, "place", "start", "end", "type", flag("opens").alias("opens"), flag("joined").alias("joined"), F.col("score").cast("float").alias("score"))
    rows = rows.withColumn("tag_stretch", F.sum(breaks.cast("long")).over(order)).where("type IS NOT NULL")
    within = Window.partitionBy(*keys, "tag_stretch").orderBy("place")
    opened = F.coalesce(F.sum(F.col("opens").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("tag_new", (F.col("opens") & (~F.col("joined") | (opened == 0))).cast("long"))
    rows = rows.withColumn("tag_entity", F.sum("tag_new").over(within)).where("tag_entity > 0")
    scores = F.array_sort(F.collect_list(F.struct("place", "score")))
    made = rows.groupBy(*keys, "tag_stretch", "tag_entity", "type").agg(F.min_by("start", "place").alias("start"), F.max_by("end", "place").alias("end"), scores.alias("tag_scores"), F.count(F.lit(1)).alias("n_tokens"))
    halved = F.aggregate(F.slice("tag_scores", 2, F.size("tag_scores")), F.col("tag_scores")[0]["score"], lambda acc, s: ((acc + s["score"]) / 2).cast("float"))
    return made.select(*keys, "type", "start", "end", halved.alias("score"), "n_tokens")
