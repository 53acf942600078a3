"""Masking, restoring and spans on inline texts."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.entities import ENTITIES, Switches
from palimpsest.functions.rules import PatternError, Rule, merged, native, translate
from palimpsest.functions.spans import SPAN, normalized, running_sum
from palimpsest.operators.masking import ITEM, Options, lookup, mask_frame, masked, restore_frame, restored, roundtrip_frame, span_frame
from palimpsest.sources import texts

PEM = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"

CASES = [
    ("mail me: a.b+c@example.com!", "mail me: __PII_EMAIL_ADDRESS_1__!"),
    ("1234 5678", "__PII_PHONE_NUMBER_1__"),
    ("1234 and 5678", "__PII_VERIFICATION_CODE_1__ and __PII_VERIFICATION_CODE_2__"),
    ("国贸中心A座1208室", "国贸中心A座1208室"),
    ("１２３４５６７８９０", "__PII_PHONE_NUMBER_1__"),
    ("pwd: secret tail", "pwd: __PII_PASSWORD_1__ tail"),
    ("á1234", "á1234"),
    ("a‌1234", "a‌1234"),
    ("4242424242424242", "__PII_PHONE_NUMBER_1__"),
    ("my password: hunter2", "my password: hunter2"),
    ("my pwd: hunter2", "my pwd: __PII_PASSWORD_1__"),
    ("otp ABCDEFGHIJKLotp: 12345", "otp __PII_VERIFICATION_CODE_1__otp: __PII_VERIFICATION_CODE_2__"),
    ("🙏é 1234 x", "🙏é __PII_VERIFICATION_CODE_1__ x"),
    ("a@b.com1x@c.de", "__PII_EMAIL_ADDRESS_1____PII_EMAIL_ADDRESS_2__"),
    ("see https://example.com/a?b=c now", "see __PII_URL_ADDRESS_1__ now"),
    (f"key {PEM} end", "key __PII_PRIVATE_KEY_1__ end"),
    (PEM.replace("RSA ", ""), PEM.replace("RSA ", "")),
    ("x " + "0a" * 32 + " y", "x __PII_PRIVATE_KEY_1__ y"),
    ("Seed: " + " ".join(["river"] * 12), "__PII_RANDOM_SEED_1__"),
    ("seed phrase: " + " ".join(["river"] * 12), "seed phrase: " + " ".join(["river"] * 12)),
    ("verify code - 9F4T2A.", "verify code - __PII_VERIFICATION_CODE_1__."),
    ("text with ﷐ and 12345", "text with ﷐ and __PII_VERIFICATION_CODE_1__"),
    ("", ""),
    (None, None),
]


def test_masks_each_case(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    got = {r.i: r for r in roundtrip_frame(df).collect()}
    for i, (text, want) in enumerate(CASES):
        assert got[i].masked == want, text
        assert got[i].same


def test_switched_off_kinds_still_win(spark):
    options = Options(switches=Switches().disable("PHONE_NUMBER"))
    df = spark.createDataFrame([("4242424242424242 and a@b.cd",)], "text string")
    row = mask_frame(df, options=options).first()
    assert row.masked == "4242424242424242 and __PII_EMAIL_ADDRESS_1__"
    assert [(i.id, i.type, i.start, i.end) for i in row.meta["items"]] == [(1, "EMAIL_ADDRESS", 21, 27)]


def test_switches():
    assert [k for k in ENTITIES if not Switches().enabled(k)] == ["PHYSICAL_ADDRESS"]
    assert Switches().patched({"maskAll": False, "maskEmail": True, "maskUrl": None, "other": True}) == Switches.none().enable("EMAIL_ADDRESS")
    assert Switches().patched({"maskAll": True}) == Switches.all()


def test_restoring(spark):
    items = "array<struct<id:bigint,type_id:tinyint,type:string,start:int,end:int,score:float>>"
    rows = [
        ("b __PII_EMAIL_ADDRESS_2__ a __PII_EMAIL_ADDRESS_1__", "x@y.zz q@w.ee", [(1, 2, "", 0, 6, 1.0), (2, 2, "", 7, 13, 1.0)], "b q@w.ee a x@y.zz"),
        ("__PII_EMAIL_ADDRESS_1__ (again __PII_EMAIL_ADDRESS_1__)", "x@y.zz", [(1, 2, "", 0, 6, 1.0)], "x@y.zz (again __PII_EMAIL_ADDRESS_1__)"),
        ("unknown __PII_EMAIL_ADDRESS_9__", "x@y.zz", [(1, 2, "", 0, 6, 1.0)], "unknown __PII_EMAIL_ADDRESS_9__"),
        ("beyond __PII_EMAIL_ADDRESS_1__", "x", [(1, 2, "", 0, 6, 1.0)], "beyond __PII_EMAIL_ADDRESS_1__"),
        ("é🙏 __PII_URL_ADDRESS_1__", "日本", [(1, 12, "", 0, 3, 1.0)], "é🙏 日"),
        ("plain", "x", [], "plain"),
        ("plain", None, None, "plain"),
    ]
    df = spark.createDataFrame(rows, f"reply string, original string, items {items}, want string")
    for r in df.withColumn("got", restored(F.col("reply"), F.col("original"), F.col("items"))).collect():
        assert r.got == r.want
    assert df.select(lookup(F.col("original"), F.col("items"), F.lit(2)).alias("v")).first().v == "q@w.ee"


def test_reply_without_credential_stays(spark):
    df = spark.createDataFrame([(1, "call +1 415-555-2671"), (2, "none")], "id int, text string")
    out = mask_frame(df)
    replies = out.select("id", "masked").withColumnRenamed("masked", "reply").unionAll(spark.createDataFrame([(3, "x __PII_URL_ADDRESS_1__")], "id int, reply string"))
    got = {r.id: r.restored for r in restore_frame(replies, out, "id").collect()}
    assert got == {1: "call +1 415-555-2671", 2: "none", 3: "x __PII_URL_ADDRESS_1__"}


def test_span_frame(spark):
    df = spark.createDataFrame([(7, "é 1234 a@b.cd")], "k int, text string")
    assert [tuple(r) for r in span_frame(df, ["k"]).select("k", "id", "type", "start", "end", "span_text").collect()] == [(7, 1, "VERIFICATION_CODE", 3, 7, "1234"), (7, 2, "EMAIL_ADDRESS", 8, 14, "a@b.cd")]


def test_further_rules(spark):
    inside = Rule("TOKEN", "PASSWORD", r"(?i)token=(\w+);end", 0.9, 1)
    assert not native(inside)
    df = spark.createDataFrame([("é token=abc;end TOKEN=d;end",)], "text string")
    assert mask_frame(df, options=Options(rules=merged((inside,)))).first().masked == "é token=__PII_PASSWORD_1__;end TOKEN=__PII_PASSWORD_2__;end"
    last = Rule("TICKET", "PAYMENT", r"\bT-(\d+)", 0.9, 1)
    assert native(last)
    df = spark.createDataFrame([("see T-42 or XT-43",)], "text string")
    assert mask_frame(df, options=Options(rules=merged((last,)))).first().masked == "see T-__PII_PAYMENT_1__ or XT-43"


def test_validators_score_anew(spark):
    options = Options(validators={"BANK": lambda text, score: 0.95 if text.endswith("2") else 0.1})
    df = spark.createDataFrame([(1, "4242424242424242"), (2, "4242424242424241")], "i int, text string")
    got = {r.i: r.masked for r in mask_frame(df, options=options).collect()}
    assert got == {1: "__PII_BANK_NUMBER_1__", 2: "__PII_PHONE_NUMBER_1__"}


def test_bad_patterns():
    for pattern in (r"a\bc", r"a\Bc", r"[\S]", r"[a\D]"):
        with pytest.raises(PatternError):
            translate(Rule("X", "PASSWORD", pattern, 0.9))
    with pytest.raises(PatternError):
        translate(Rule("X", "PASSWORD", "abc", 0.9, 1))


@pytest.mark.parametrize("pattern, ahead", [(r"\b\d{12,19}\b", r"(?=[\p{Nd}]{12})"), (r"\b[0-9a-f]{6}\b", "(?=[0-9a-f]{6})"), (r"\b\d+x", r"(?=[\p{Nd}])"), (r"\b\d*x", ""), (r"\b\d{4}?x", ""), (r"\b\d+|foo\b", ""), (r"\d{4}", "")])
def test_what_must_come_first_is_looked_for_first(pattern, ahead):
    made = translate(Rule("X", "PASSWORD", pattern, 0.9))
    assert made.startswith(f"{ahead}(") and made.startswith("(?=") == bool(ahead)


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([("a@b.cd", 1, "x")], "text string, start int, items string")
    row = mask_frame(df).first()
    assert (row.start, row["items"], row.masked) == (1, "x", "__PII_EMAIL_ADDRESS_1__")


def test_plan_is_one_stage_without_python(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("text")).withColumn("m", masked(F.col("text")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_long_texts_take_linear_time(spark):
    """A megabyte of codes."""
    n = 100_000
    df = spark.createDataFrame([("code 1234 " * n,)], "text string")
    roundtrip_frame(df.limit(0)).count()
    began = time.perf_counter()
    row = roundtrip_frame(df).select("same", "n_items").first()
    assert (row.same, row.n_items) == (True, n) and time.perf_counter() - began < 30


def test_running_and_groups(spark):
    """Runs of every length, and spans that overlap through others, against plain loops."""
    rng = random.Random(4)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in [0, 1, 2, 3, 4, 5, 9, 10, 17, 100, 101, 1000]]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>").select("i", running_sum(F.col("x")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: list(itertools.accumulate(x)) for i, x in enumerate(lists)}
    cases = []
    for i in range(200):
        spans = [(a := rng.randint(0, 60), a + rng.randint(1, 12), rng.choice([0.5, 0.7, 0.9]), k) for k in range(rng.randint(0, 25))]
        cases.append((i, [(s, e, w, k, 1, "t") for s, e, w, k in spans]))
    got = spark.createDataFrame(cases, f"i int, spans array<{SPAN}>").select("i", normalized(F.col("spans")).alias("s")).collect()
    for r in got:
        kept = []
        for s in sorted(cases[r.i][1], key=lambda s: (-s[2], s[0] - s[1], s[0], s[3])):
            if all(s[1] <= o[0] or o[1] <= s[0] for o in kept):
                kept.append(s)
        assert [(s.start, s.end, s.ord) for s in r.s] == [(s[0], s[1], s[3]) for s in sorted(kept)]


def test_columns_of_the_user_stay(spark):
    df = spark.createDataFrame([(1, "a@b.cd", "x", "y", "z")], "i int, text string, masking string, masking_spans string, item string")
    assert mask_frame(df).first()[:5] == (1, "a@b.cd", "x", "y", "z")
    assert span_frame(df, ["i", "masking", "item"]).first()[:3] == (1, "x", "z")
    out = mask_frame(df, masked_col="text2", meta_col="meta2")
    replies = out.select("i", F.col("text2").alias("reply"), F.lit("mine").alias("meta"), F.lit("held").alias("held_meta"))
    back = restore_frame(replies, out, "i", meta_col="meta2").first()
    assert (back.restored, back.meta, back.held_meta) == ("a@b.cd", "mine", "held")
    for name in ("masked", "META"):
        with pytest.raises(ValueError, match="exist already"):
            mask_frame(df.withColumn(name, F.lit(1)))
    with pytest.raises(ValueError, match="exist already"):
        roundtrip_frame(df.withColumn("same", F.lit(1)))


def test_envelope(spark, monkeypatch):
    monkeypatch.setattr(texts, "MAX_TEXT", 20)
    df = spark.createDataFrame([(1, "a@b.cd"), (2, None), (3, "x" * 21)], "i int, text string")
    got = {r.i: r for r in mask_frame(df, error_col="error").collect()}
    assert got[1].masked == "__PII_EMAIL_ADDRESS_1__" and got[1].error is None and got[1].meta.original == "a@b.cd"
    assert [(got[i].masked, got[i].meta, got[i].error.code) for i in (2, 3)] == [(None, None, 400), (None, None, 413)]


def test_placeholders_that_share_their_ends(spark):
    original = "a@b.cd"
    items = [(1, 2, "EMAIL_ADDRESS", 0, 6, 0.9), (2, 2, "EMAIL_ADDRESS", 0, 1, 0.9), (12, 2, "EMAIL_ADDRESS", 1, 2, 0.9), (3, 2, "EMAIL_ADDRESS", 5, 9, 0.9)]
    cases = {
        "___PII_EMAIL_ADDRESS_1__PII_EMAIL_ADDRESS_2___": "_a@b.cda_",
        "__PII_EMAIL_ADDRESS_12__ __PII_EMAIL_ADDRESS_1__ __PII_EMAIL_ADDRESS_1__": "@ a@b.cd __PII_EMAIL_ADDRESS_1__",
        "__PII_X__PII_EMAIL_ADDRESS_1__ __PII_EMAIL_ADDRESS_3__": "__PII_Xa@b.cd __PII_EMAIL_ADDRESS_3__",
        "__PII_PHONE_NUMBER_1__ __PII_EMAIL_ADDRESS_01__": "__PII_PHONE_NUMBER_1__ __PII_EMAIL_ADDRESS_01__",
        "": "",
    }
    df = spark.createDataFrame([(r, original, items) for r in cases], f"reply string, original string, items array<{ITEM}>")
    assert {r.reply: r.out for r in df.select("reply", restored(F.col("reply"), F.col("original"), F.col("items")).alias("out")).collect()} == cases
