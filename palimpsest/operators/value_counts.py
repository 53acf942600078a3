"""How many different values, and which most often: sketches that can be written and merged, and an exact second look.

Values are any column of a table of items, for example of span_frame. Nulls count nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_sketches(items: DataFrame, by: list[str], value: str, bits: int = 14) -> DataFrame:
    """(by, sketch): one HyperLogLog sketch a group, of 2^bits registers; to be written, and merged at any time."""
    return items.groupBy(*by).agg(F.hll_sketch_agg(value, bits).alias("sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_values): estimates for coarser groups, of sketches of any number of days, tables or parts."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_values"))


def top_values(items: DataFrame, value: str, k: int, slots: int = 10_000) -> DataFrame:
    """(value, n) of the k most frequent values, exactly; ties by value. At most k rows.

    Each part of the table is counted in a frequent-items sketch of bounded size, and these are combined; the candidates are then
    counted for all rows. A value that is no candidate has at most the sketch's error, a few times rows / slots; if the k-th candidate
    does not exceed that, as in a table of values that are nearly all different, every value is counted after all.
    """
    spark, rows = items.sparkSession, items.where(F.col(value).isNotNull()).select(F.col(value).cast("string").alias("value"))
    counts = lambda df: df.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    best = lambda df: df.orderBy(F.desc("n"), "value").limit(k)
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "value string, n long")
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.expr(f"approx_top_k_accumulate(value, {slots})").alias("sketch"))
    found = parts.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch), {min(slots, 10_000)})").alias("top")).select(F.explode("top").alias("t")).select("t.item")
    exact = counts(rows.join(found, F.col("value") == F.col("item"), "left_semi"))
    last = best(exact).agg(F.count(F.lit(1)).alias("held"), F.min("n").alias("least")).first()
    # The sketch holds a table of the power of two above slots / 0.75, errs by 3.5 / that size of all rows at most, and leaves out
    # what it can't tell from as many.
    error = total * 7 / (1 << (int(slots / 0.75) - 1).bit_length())
    return best(exact) if last.held == k and last.least > error else best(counts(rows))
