"""Interval algebra against plain Python, on random spans."""

import random

from pyspark.sql import functions as F

from palimpsest.functions.spans import SPAN, dedup_same_range, normalized, sort_by_start


def plain(spans, least=0.5):
    """Sort, filter, one of each range, greedy choice."""
    spans = sorted((s for s in spans if s[2] >= least), key=lambda s: (s[0], s[1], s[3]))
    one = {}
    for s in spans:
        if s[:2] not in one or s[2] > one[s[:2]][2]:
            one[s[:2]] = s
    taken = []
    for s in sorted(one.values(), key=lambda s: (-s[2], s[0] - s[1], s[0], s[3])):
        if all(s[1] <= t[0] or t[1] <= s[0] for t in taken):
            taken.append(s)
    return sorted(taken)


def test_normalized_like_plain(spark):
    rng = random.Random(11)
    rows = []
    for k in range(300):
        spans = []
        for order in range(rng.randint(0, 9)):
            start = rng.randint(0, 12)
            spans.append((start, start + rng.randint(1, 6), rng.choice([0.25, 0.5, 0.5, 0.75, 1.0]), order, 1, "t"))
        rows.append((k, spans))
    df = spark.createDataFrame(rows, f"k int, spans array<{SPAN}>")
    for r in df.select("k", "spans", normalized(F.col("spans")).alias("got"), sort_by_start(F.col("spans")).alias("by_start"), dedup_same_range(F.col("spans")).alias("one")).collect():
        own = [tuple(s) for s in r.spans]
        assert [tuple(s) for s in r.got] == plain(own)
        assert [tuple(s) for s in r.by_start] == sorted(own, key=lambda s: (s[0], s[1], s[3]))
        assert len(r.one) == len({s[:2] for s in own})


def test_tables_of_spans(spark):
    from palimpsest.operators.intervals import apart, covered, normalized_table, overlapping

    left = spark.createDataFrame([(1, 0, 5, "a"), (1, 5, 9, "b"), (2, 0, 3, "c"), (None, 1, 2, "d")], "k int, start int, end int, name string")
    right = spark.createDataFrame([(1, 4, 5), (1, 5, 20), (None, 0, 9)], "k int, start int, end int")
    assert sorted(r.name for r in overlapping(left, right, ["k"]).collect()) == ["a", "b", "d"]
    assert sorted(r.name for r in apart(left, right, ["k"]).collect()) == ["c"]
    assert sorted(r.name for r in covered(left, right, ["k"]).collect()) == ["b", "d"]
    rows = [(1, 0, 5, 0.9, 0, 1, "t"), (1, 3, 9, 0.8, 1, 1, "t"), (1, 9, 10, 0.4, 2, 1, "t"), (2, 3, 9, 0.8, 1, 1, "t")]
    table = spark.createDataFrame(rows, "k int, start int, end int, score float, ord int, type_id byte, source string")
    assert sorted((r.k, r.start, r.end) for r in normalized_table(table, ["k"]).collect()) == [(1, 0, 5), (2, 3, 9)]
