"""Hard negatives against their definition, on rows of every kind."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives
from palimpsest.llm.hard_negatives import mine, packed, product, unpacked

ROWS = "vec_id long, embedding array<double>, label int, id string, score long"


def by_force(rows, anchor, positives=5, negatives=5, low=80, high=100):
    held = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if any(abs(x) > math.sqrt(2**56 / max(len(v), 1)) / 256 - 1 for x in v):
            continue
        held[i] = min(held.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in held.items()}
    out = set()
    for a in filter(anchor, whole):
        label, v = whole[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for i, (own, w) in whole.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            near = [(n, i) for n, i, own in scored if own != label and low * -s <= 100 * -n <= high * -s]
            out |= {(a, p, r, i, -s, -n) for r, (n, i) in enumerate(near[:negatives], 1)}
    return out


def some_rows(n=300, size=9, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(size)]
        if i % 3 == 0 and rows:  # copies and near copies, whatever their labels
            v = list(rows[rng.randrange(len(rows))][1])
            v[rng.randrange(len(v))] += rng.choice([0, 0, 0.01])
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2, 9])))
    rows += [(1000, None, 1), (1001, [1.0] * size, None), (None, [1.0] * size, 0), (1010, [float("nan")] + [1.0] * (size - 1), 0), (1020, [float("inf")] * size, 1)]
    rows += [(1030, [None] * size, 0), (1040, [], 0), (1041, [], 1), (1050, [], 0), (1060, [1.0, 2.0], 0), (1061, [1.0, 1.5], 1), (1070, [1.0, 2.0], 0), (1080, [0.0] * size, 0), (1081, [-0.0] * size, 1)]
    rows += [(30, [5.0] * size, 5), rows[30], rows[50], (1090, [1e30] * size, 0), (-10, [0.5] * size, 0), (-3, [0.4] * size, 1)]
    return rows


@pytest.mark.parametrize("shape", [{}, {"block_rows": 7, "block_anchors": 3, "chunks": 3, "panel_bytes": 1500}, {"chunks": 1, "positives": 2, "negatives": 50, "low": 50, "high": 120}])
def test_equals_brute_force(spark, shape):
    rows = some_rows()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS).repartition(3)
    got = mine(frame, "id % 10 = 0", **shape)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = [tuple(r) for r in got.collect()]
    how = {k: v for k, v in shape.items() if k in ("positives", "negatives", "low", "high")}
    assert len(found) == len(set(found)) and set(found) == by_force(rows, lambda i: i % 10 == 0, **how)


def test_large_components_and_rare_labels(spark):
    """Scores beyond double precision; labels so rare that most tiles hold no positive."""
    rng = random.Random(4)
    rows = [(i, [rng.uniform(1, 2) * 9e4 for _ in range(4)], i % 40) for i in range(160)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
    got = {tuple(r) for r in mine(frame, "id % 9 = 0", block_rows=30, block_anchors=8).collect()}
    assert got == by_force(rows, lambda i: i % 9 == 0) and max(r[4] for r in got) > 1 << 50


def test_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert mine(empty, "id % 10 = 0").count() == 0
    one = spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert mine(one, "id = 0").count() == 0 and mine(one, "id = 1").count() == 0


def test_query_moves_labels(spark, tmp_path):
    rows = [r for r in some_rows(120, 6) if r[1] is not None]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("anchor_id", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, v, (label + 1) % 10 if i is not None and label is not None and i % 7 == 0 else label) for i, v, label in rows]
    assert {tuple(r) for r in hard_negatives.op11_hard_negatives(spark, str(tmp_path)).collect()} == by_force(moved, lambda i: i % 100 == 0)


def test_tiles_keep_their_integers():
    rng = np.random.default_rng(1)
    for most in (1 << 6, 1 << 20, 1 << 27):
        a, b = rng.integers(-most, most, (5, 8)), rng.integers(-most, most, (3, 8))
        tile = product(a, b, most * most)
        assert (tile == [[sum(int(x) * int(y) for x, y in zip(r, q)) for q in b] for r in a]).all()
        assert (unpacked(*packed(tile), tile.shape) == tile).all()
    assert unpacked(*packed(np.zeros((3, 0), np.int64)), (3, 0)).shape == (3, 0)
