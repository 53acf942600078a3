"""Leaks, runs of tags, counts of values and the table function, each against brute force."""

import random
import re
from collections import Counter

import regex
from pyspark.sql import functions as F

from palimpsest.functions.rules import RULES, WORD, Rule
from palimpsest.functions.spans import rule_spans, split_words
from palimpsest.operators.leaks import leaks
from palimpsest.operators.masking import mask_frame
from palimpsest.operators.scanning import luhn, register_spans, scan_rules
from palimpsest.operators.tag_runs import entities
from palimpsest.operators.value_counts import distinct_sketches, merged, top_values

_WORD = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", WORD)


def stands(text, value):
    """Somewhere in the text, with no word going on at either end."""
    word = lambda c: bool(regex.match(f"[{_WORD}]", c))
    at = text.find(value)
    while at >= 0:
        end = at + len(value)
        if not (at and word(text[at - 1]) and word(value[0])) and not (end < len(text) and word(text[end]) and word(value[-1])):
            return True
        at = text.find(value, at + 1)
    return False


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    secrets = ["tiger77", "zebra!x", "ab.cd", "Ünder_1", "a\\Eb", "x-y-z", "lion lion", "77", "(((", "ocelot"]
    labels = ["pwd: ", "passcode = ", "otp ", ""]
    texts = []
    for i in range(160):
        words = [rng.choice(labels) + rng.choice(secrets) + rng.choice(["", "", "s", ".", "1"]) if rng.random() < 0.4 else rng.choice(["the", "ocelot", "77", "mail a@b.cd", "é"]) for _ in range(rng.randint(0, 6))]
        texts.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    texts += [(500, None), (501, ""), (None, "pwd: tiger77"), (None, "tiger77")]
    masks = mask_frame(spark.createDataFrame(texts, "k int, text string").withColumn("value_", F.lit(1)).repartition(3))
    rows = masks.collect()
    held = Counter((i.type, r.text.encode()[i.start : i.end].decode()) for r in rows if r.meta["items"] for i in r.meta["items"])
    held = {v: n for v, n in held.items() if len(v[1]) >= 4 and regex.search(f"[{_WORD}]", v[1])}
    want = {(r.k, *v, n) for r in rows if r.k is not None and r.masked for v, n in held.items() if stands(r.masked, v[1])}
    got = leaks(masks, ["k"]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20 and len(held) > 8
    assert leaks(masks.limit(0), ["k"]).count() == 0


def runs(tokens):
    out, held = [], None
    for place, start, end, kind, opens, joined, score in sorted(tokens):
        if held and (kind != held["type"] or (opens and not joined)):
            out.append(held)
            held = None
        if held:
            held |= {"end": end, "score": (held["score"] + score) / 2, "n": held["n"] + 1}
        elif kind and opens:
            held = {"type": kind, "start": start, "end": end, "score": score, "n": 1}
    return out + ([held] if held else [])


def test_runs_of_tags(spark):
    rng, rows = random.Random(9), []
    for k in range(80):
        for place in rng.sample(range(30), rng.randint(0, 18)):
            rows.append((k, place, place * 3, place * 3 + 2, rng.choice([None, "A", "A", "A", "B"]), rng.choice([True, False, False, None]), rng.choice([True, False, None]), rng.choice([0.5, 0.25, 1.0])))
    frame = spark.createDataFrame(rows, "k int, place int, start int, end int, type string, opens boolean, joined boolean, score double").repartition(3)
    got = sorted((r.k, r.start, r.end, r.type, round(r.score, 5), r.n_tokens) for r in entities(frame, ["k"]).collect())
    want = sorted((k, e["start"], e["end"], e["type"], round(e["score"], 5), e["n"]) for k in range(80) for e in runs([(r[1], r[2], r[3], r[4], bool(r[5]), bool(r[6]), r[7]) for r in rows if r[0] == k]))
    assert got == want and len(want) > 80
    assert entities(frame.limit(0), ["k"]).count() == 0


def test_most_frequent_values(spark):
    rng = random.Random(1)
    for values in ([rng.choice("abcdefghij") * rng.randint(1, 40) for _ in range(4000)], [str(i) for i in range(900)], ["x", None, "x", None, None], []):
        frame = spark.createDataFrame([(v,) for v in values], "v string").repartition(5)
        want = sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:7]
        assert [tuple(r) for r in top_values(frame, "v", 7, slots=64).collect()] == want


def test_sketches_of_parts_merge(spark, tmp_path):
    frame = spark.range(60_000).selectExpr("id % 7 part", "id % 3 kind", "cast(id % 20011 as string) v").withColumn("v", F.when(F.col("part") > 0, F.col("v")))
    for part in (0, 1):
        distinct_sketches(frame.where(f"part % 2 = {part}"), ["part", "kind"], "v").write.mode("append").parquet(f"{tmp_path}/sketches")
    sketches = spark.read.parquet(f"{tmp_path}/sketches")
    exact = {r.kind: r.n for r in frame.groupBy("kind").agg(F.count_distinct("v").alias("n")).collect()}
    near = {r.kind: r.n_values for r in merged(sketches, ["kind"]).collect()}
    assert near.keys() == exact.keys() and all(abs(near[k] - exact[k]) <= 0.05 * exact[k] for k in exact)
    assert abs(merged(sketches, []).first().n_values - frame.agg(F.count_distinct("v")).first()[0]) <= 0.05 * 20011


def test_table_function(spark):
    inner = Rule("INNER", "PASSWORD", r"secret=(\w+);", 0.9, 1)
    rules = (*RULES, inner)
    texts = [(1, "é secret=abc; card 4111111111111111, 4111111111111112 and a@b.cd otp: 98765"), (2, None), (3, ""), (4, "secret=x; " * 50), (None, "http://x.y"), (1, "é secret=abc; twice")]
    frame = spark.createDataFrame(texts, "k long, text string")
    frame.createOrReplaceTempView("spans_in")
    register_spans(spark, "test_spans", rules, {"BANK": luhn})
    got = spark.sql("SELECT * FROM test_spans(TABLE(SELECT k, text FROM spans_in)) WHERE ord <> 0 OR start >= 0")
    want = frame.select("k", F.explode(scan_rules(list(rules), {"BANK": luhn}, 0)(F.col("text"))).alias("s")).select(F.col("k").alias("key"), "s.start", "s.end", "s.score", "s.ord", "s.type_id")
    told = lambda df: sorted(tuple((x is None, x or 0) for x in r) for r in df.collect())
    assert told(got) == told(want) and got.count() >= 60
    assert {round(r.score, 2) for r in got.where("ord = 2 AND key = 1").collect()} == {0.6, 0.3}
    assert spark.sql("SELECT * FROM test_spans(TABLE(SELECT k, text FROM spans_in WHERE false))").count() == 0


def test_masks_of_a_leak_audit_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def once(text):
        seen.add(1)
        return text

    texts = spark.createDataFrame([(i, "the pwd: quagmire77 is new" if i == 0 else f"she said quagmire77 aloud {i}") for i in range(6)], "k long, text string")
    masks = mask_frame(texts.withColumn("text", once.asNondeterministic()("text")))
    assert sorted(r.k for r in leaks(masks, ["k"]).collect()) == [1, 2, 3, 4, 5] and seen.value == 6


def test_runs_of_dense_tokens_move_tagged_ones_only(spark):
    rng = random.Random(8)
    rows = [(k, i, 4 * i, 4 * i + 3, rng.choice(["A", "B", None, None]), rng.random() < 0.5, rng.random() < 0.3, rng.random()) for k in range(20) for i in range(30)]
    tokens = spark.createDataFrame(rows, "k long, place int, start int, end int, type string, opens boolean, joined boolean, score double")
    assert sorted(entities(tokens, ["k"], dense=True).collect()) == sorted(entities(tokens, ["k"]).collect())
    assert "isnotnull(type" in entities(tokens, ["k"], dense=True)._jdf.queryExecution().optimizedPlan().toString().rsplit("Window", 1)[1]


def test_words_are_split_as_the_rule_finds_them(spark):
    texts = ["a bc d  é中 \U0001f600x\n", "", " ", None, "one", " lead and trail ", "​x\x1fy z" * 40]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rule = Rule("WORD", "USER_NAME", r"\S+", 1.0)
    found = rule_spans(F.col("text"), rule, 0)
    for r in frame.select("text", split_words(F.col("text")).alias("w"), found.alias("s")).collect():
        assert [(w.start, w.end) for w in r.w or []] == [(s.start, s.end) for s in r.s or []]
        assert [w.word.encode() for w in r.w or []] == [r.text.encode()[s.start : s.end] for s in r.s or []]
    # What stands before a span that is the whole match is not looked for.
    assert frame.select(found)._jdf.queryExecution().analyzed().toJSON().count(".RegExpExtractAll\"") == 1
