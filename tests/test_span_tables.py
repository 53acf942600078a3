"""Spans in rows: sweeps against brute force, masking from a written table against masking itself."""

import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.entities import Switches
from palimpsest.functions.rules import RULES
from palimpsest.functions.spans import candidates
from palimpsest.operators.intervals import apart, covered, normalized_table, overlapping
from palimpsest.operators.masking import Options, mask_frame
from palimpsest.operators.span_tables import dedup_table, mask_from_spans, sanitized_table


def spans_of(rng, n, keys=(1, 2, None), reach=60):
    rows = []
    for i in range(n):
        start = rng.choice([None, *range(-3, reach)]) if rng.random() < 0.1 else rng.randint(0, reach)
        end = None if rng.random() < 0.03 else (start or 0) + rng.choice([0, 1, 1, 2, 5, 30])
        rows.append((rng.choice(keys), "x", start, end, i))
    return rows


@pytest.mark.parametrize("width, salts", [(1 << 12, 4), (7, 1), (1, 3)])
def test_sweeps_equal_brute_force(spark, width, salts):
    rng = random.Random(width)
    left, right = spans_of(rng, 150), spans_of(rng, 40)
    left += left[:5]
    schema = "k int, `select` string, start int, end int, sweep_at int"
    a, b = spark.createDataFrame(left, schema).repartition(3), spark.createDataFrame(right, schema)
    whole = lambda s: s[2] is not None and s[3] is not None
    tests = {
        overlapping: lambda s: any(s[0] == t[0] and whole(s) and whole(t) and s[2] < t[3] and t[2] < s[3] for t in right),
        covered: lambda s: any(s[0] == t[0] and whole(s) and whole(t) and t[2] <= s[2] and t[3] >= s[3] for t in right),
    }
    tests[apart] = lambda s: not tests[overlapping](s)
    for operator, keep in tests.items():
        key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
        got = operator(a, b, ["k", "select"], width, salts)
        assert got.columns == a.columns
        assert sorted(map(tuple, got.collect()), key=key) == sorted(filter(keep, left), key=key), operator.__name__
    plan = overlapping(a, b, ["k"])._jdf.queryExecution().toString()
    assert "Join" not in plan
    assert overlapping(a, b.limit(0), ["k"]).count() == 0 and apart(a, b.limit(0), ["k"]).count() == len(left) and overlapping(a.limit(0), b, ["k"]).count() == 0


def test_one_key_with_very_many_spans(spark):
    n = 100_000
    spans = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 5).cast("int").alias("end"))
    other = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10 + 4 + F.col("id") % 2).cast("int").alias("start"), (F.col("id") * 10 + 8).cast("int").alias("end"))
    began = time.perf_counter()
    assert overlapping(spans, other, ["k"]).count() == n // 2 and apart(spans, other, ["k"]).count() == n // 2
    assert time.perf_counter() - began < 30


def test_normalized_rows_equal_arrays(spark):
    from test_spans import plain

    rng, rows = random.Random(3), []
    for k in range(60):
        for order in range(rng.randint(0, 14)):
            start = rng.randint(0, 25)
            rows.append((k, start, start + rng.randint(1, 8), rng.choice([0.3, 0.5, 0.6, 0.9]), order, rng.randint(1, 12), "t"))
    frame = spark.createDataFrame(rows, "k int, start int, end int, score float, ord int, type_id byte, source string").repartition(3)
    got = {}
    for r in normalized_table(frame, ["k"]).collect():
        got.setdefault(r.k, []).append((r.start, r.end, round(r.score, 2), r.ord))
    own = {k: [r[1:5] for r in rows if r[0] == k] for k in range(60)}
    assert {k: sorted(v) for k, v in got.items()} == {k: [tuple(s[:4]) for s in plain(v)] for k, v in own.items() if plain(v)}


TEXTS = [(1, "call +44 20 7946 0018 or write a@b.cd, otp: 98765 and pwd = s3cret"), (2, "ünï 1234 5678 card 5555444433332222 x"), (3, None), (4, ""), (5, "nothing"), (None, "no id 4321 x"), (1, "a@b.cd")]


@pytest.mark.parametrize("switches", [Switches(), Switches().disable("PHONE_NUMBER")])
def test_masking_from_a_written_table(spark, tmp_path, switches):
    texts = spark.createDataFrame(TEXTS[:-1], "doc_id int, text string").withColumn("start", F.lit("clash"))
    found = texts.select("doc_id", F.explode(candidates(F.col("text"), RULES)).alias("s")).select("doc_id", "s.*")
    wrong = spark.createDataFrame([(1, 0, 999, 1.0, 1, 2, "x"), (1, 5, 5, 1.0, 1, 2, "x"), (1, -1, 3, 1.0, 1, 2, "x"), (1, 0, 3, 1.0, 1, 13, "x"), (5, 0, 2, 0.4, 1, 2, "x"), (9, 0, 2, 1.0, 1, 2, "x"), (3, 0, 1, 1.0, 1, 2, "x")], found.schema)
    found.unionAll(found).unionAll(wrong).repartition(4).write.parquet(f"{tmp_path}/spans")
    options = Options(switches=switches)
    got = mask_from_spans(texts, spark.read.parquet(f"{tmp_path}/spans"), ["doc_id"], options=options)
    want = mask_frame(texts, options=options)
    told = lambda df: sorted((r.doc_id or 0, r.masked or "", str(r.meta), r.start) for r in df.collect())
    assert told(got) == told(want) and got.columns == want.columns


def test_tables_of_one_range_and_beyond_texts(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id int, text string")
    rows = [(1, 0, 4, 0.5, 2, 2), (1, 0, 4, 0.9, 3, 5), (1, 0, 4, 0.9, 1, 7), (1, 0, 5, 0.1, 0, 2), (None, 0, 2, 0.5, 0, 2), (4, 0, 1, 0.5, 0, 2), (2, 0, 500, 0.5, 0, 2)]
    spans = spark.createDataFrame(rows, "doc_id int, start int, end int, score double, ord int, type_id int")
    assert sorted(dedup_table(spans, ["doc_id"]).where("doc_id = 1").select("end", "ord").collect()) == [(4, 1), (5, 0)]
    assert {r.doc_id for r in sanitized_table(texts, spans, ["doc_id"]).collect()} == {1, None}
    out = mask_from_spans(texts, spans, ["doc_id"])
    assert {r.masked for r in out.where("doc_id IS NULL").collect()} == {"__PII_EMAIL_ADDRESS_1__ id 4321 x"}
    assert mask_from_spans(texts, spans.limit(0), ["doc_id"]).where("masked = text").count() == 6 and mask_from_spans(texts.limit(0), spans, ["doc_id"]).count() == 0
