"""Interval algebra on tables of spans: keys, start, end (half-open), and what else a row holds.

Which spans of one table meet another's is told by a sweep, not by a join. Both tables' ends become events of one sorted order, in
which the farthest end of the right table's spans so far is a running maximum; that alone says whether a span of the left table
meets any. A text's positions are cut into bins of `width`, each with what the bins before it reach, so that a text with very
many spans is many small sorts. The left table's rows are dealt over `salts` besides, for keys that hold a great share of all rows,
such as null; the right table goes into each of them, reduced to one row a start.

Nulls: keys that are null are equal; a span without start or end meets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.spans import SPAN, normalized
from palimpsest.operators.masking import fresh

_LEFT, _RIGHT, _CARRY = 1, 2, 0


def _sweep(left: DataFrame, right: DataFrame, keys: list[str], place: str, ties: bool, meets, width: int, salts: int) -> DataFrame:
    """left with a column that says whether meets(start, end, farthest end of what begins before `place`) holds.

    ties: whether spans that begin at `place` count as begun.
    """
    row, at, far, kind, salt, reach = (fresh(left, n) for n in ("sweep_row", "sweep_at", "sweep_far", "sweep_kind", "sweep_salt", "sweep_reach"))
    bin_ = fresh(left, "sweep_bin")
    binned = lambda c: F.floor(c / width)
    starts = right.where("start IS NOT NULL AND end IS NOT NULL").groupBy(*keys, F.col("start").cast("long").alias(at)).agg(F.max(F.col("end").cast("long")).alias(far))
    starts = starts.withColumn(bin_, binned(F.col(at)))
    # What the bins before one reach, at its beginning: bins with a span, and one more row for those of left that have none.
    lefts = left.select(*keys, F.struct(*left.columns).alias(row), F.col(place).cast("long").alias(at)).withColumn(bin_, binned(F.col(at)))
    hashed = [F.col(f"{row}.{f.name}") for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    lefts = lefts.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    bins = starts.groupBy(*keys, bin_).agg(F.max(far).alias(far)).unionByName(lefts.select(*keys, bin_).distinct().withColumn(far, F.lit(None).cast("long")))
    bins = bins.groupBy(*keys, bin_).agg(F.max(far).alias(far))
    carry = bins.withColumn(far, F.max(far).over(Window.partitionBy(*keys).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1))).where(F.col(far).isNotNull())
    carry = carry.withColumn(at, F.col(bin_) * width)
    none = lambda t: F.lit(None).cast(t)
    order, held = fresh(left, "sweep_order"), left.select(F.struct(*left.columns)).schema[0].dataType
    dealt = lambda df, k: df.select(*keys, bin_, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt), at, F.lit(k).alias(kind), far, none(held).alias(row))
    events = dealt(carry, _CARRY).unionAll(dealt(starts, _RIGHT)).unionAll(lefts.select(*keys, bin_, salt, at, F.lit(_LEFT).alias(kind), none("long").alias(far), row))
    rank = F.when(F.col(kind) == _CARRY, 0).when((F.col(kind) == _RIGHT) & F.lit(ties), 1).when(F.col(kind) == _LEFT, 2).otherwise(3)
    before = Window.partitionBy(*keys, bin_, salt).orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn(order, rank).withColumn(reach, F.max(far).over(before)).where(F.col(kind) == _LEFT)
    return swept.select(f"{row}.*", F.coalesce(meets(F.col(f"{row}.start"), F.col(f"{row}.end"), F.col(reach)), F.lit(False)).alias(reach))


def _kept(left: DataFrame, swept: DataFrame, keep: Column) -> DataFrame:
    return swept.where(keep).select(*left.columns)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = 1 << 12, salts: int = 4) -> DataFrame:
    """Spans of left that share a place with one of right; touching is not sharing."""
    swept = _sweep(left, right, keys, "end", False, lambda s, e, reach: reach > s, width, salts)
    return _kept(left, swept, F.col(swept.columns[-1]))


def apart(left: DataFrame, right: DataFrame, keys: list[str], width: int = 1 << 12, salts: int = 4) -> DataFrame:
    """Spans of left that share no place with any of right."""
    swept = _sweep(left, right, keys, "end", False, lambda s, e, reach: reach > s, width, salts)
    return _kept(left, swept, ~F.col(swept.columns[-1]))


def covered(left: DataFrame, right: DataFrame, keys: list[str], width: int = 1 << 12, salts: int = 4) -> DataFrame:
    """Spans of left that lie within one of right."""
    swept = _sweep(left, right, keys, "start", True, lambda s, e, reach: reach >= e, width, salts)
    return _kept(left, swept, F.col(swept.columns[-1]))


def normalized_table(spans: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Disjoint spans of each text from a table with start, end, score, ord, type_id and source: greedy, as masking chooses them.

    Of spans of one range the best stays, by rank. Spans that overlap, directly or through others, form an island, told by the
    running maximum of ends; islands of one span are done, and each other one is judged by itself.
    """
    fields = ("start", "end", "score", "ord", "type_id", "source")
    rank, reach, island, group, size = (fresh(spans, n) for n in ("span_rank", "span_reach", "span_opens", "span_island", "span_group"))
    same = Window.partitionBy(*keys, "start", "end").orderBy(F.desc("score"), "ord")
    best = spans.select(*keys, *fields).where(F.col("score") >= F.lit(least).cast("float")).withColumn(rank, F.row_number().over(same)).where(F.col(rank) == 1)
    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    opened = best.withColumn(reach, F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)))
    opened = opened.withColumn(island, F.sum((F.coalesce(F.col("start") >= F.col(reach), F.lit(True))).cast("long")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    gathered = opened.groupBy(*keys, island).agg(F.collect_list(F.struct(*fields)).cast(f"array<{SPAN}>").alias(group))
    judged = F.when(F.size(group) > 1, normalized(F.col(group), least)).otherwise(F.col(group))
    return gathered.select(*keys, F.explode(judged).alias(size)).select(*keys, *(f"{size}.{f}" for f in fields))
