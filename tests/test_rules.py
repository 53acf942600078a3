"""Rules on random texts against their own patterns, and their time on texts made to be slow."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.rules import RULES, Rule, ending, steady
from palimpsest.functions.spans import rule_spans
from palimpsest.operators.masking import mask_frame

_BY_NAME = {r.name: r for r in RULES}
_PEM = "-----BEGIN EC PRIVATE KEY-----", "-----END EC PRIVATE KEY-----"
#: Pieces of ASCII text, of which Python's own patterns see the same words and spaces as the rules.
PIECES = {
    "EMAIL": ["a", "b.c", "@", "@x.yz", ".", ".de", "-", "_", "%", "9", " ", "@q.r.st", "é", "..", "u@v.w1"],
    "SEED_PHRASE": ["seed", "Seed: ", "mnemonic=", " ", "seed :  ", "ab ", "c\n", *["word "] * 30, "x9 ", "seedling ", " : "],
    "PEM_PRIVKEY": [*_PEM, _PEM[0], "x", "\n", "-----END DSA PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----END PGP KEY-----", "é"],
    "URL": ["http://", "https://", "s://", "a.b", "/", "?x=y", " ", "]", "é", ")"],
}


@pytest.mark.parametrize("name", PIECES)
def test_spans_are_those_of_the_pattern(spark, name):
    rng, rule = random.Random(name), _BY_NAME[name]
    texts = ["".join(rng.choices(PIECES[name], k=rng.randint(1, 60 if name == "SEED_PHRASE" else 12))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [tuple(s) for s in r.s] for r in frame.select("i", F.transform(rule_spans(F.col("t"), rule, 0), lambda s: F.array(s["start"], s["end"])).alias("s")).collect()}
    size = lambda t: len(t.encode())
    want = {i: [(size(t[: m.start()]), size(t[: m.end()])) for m in re.finditer(rule.pattern, t)] for i, t in enumerate(texts)}
    assert got == want and sum(map(len, want.values())) > 100


def test_steady_patterns():
    assert steady(r"[a-z]+@x")[0] and steady(r"[a-z@]+@x") == ("", r"[a-z@]+@x") and steady(r"[a-z]+@x|b")[0] == ""
    assert steady(r"otp\s*[:=\-]?\s*([a-z]+)")[1] == r"otp\s*+(?:[:=\-]\s*+)?+([a-z]+)"
    assert ending(Rule("X", "PASSWORD", r"(?i)a[\s\S]*?(b|c)", 0.5)) == r"(?si)\A.*(?:b|c)" and ending(_BY_NAME["EMAIL"]) is None


@pytest.mark.parametrize("piece", ["a", "1", "-", "a.", "a@", "seed ", "otp:", _PEM[0] + "\n", "9 ", "pwd "])
def test_time_grows_with_length(spark, piece):
    """300 KB of what would take a careless pattern the square of it; spaces too, behind a label."""
    n = 300_000
    text = piece * (n // len(piece)) + " otp" + " " * n + "@"
    began = time.perf_counter()
    mask_frame(spark.createDataFrame([(text,)], "text string")).selectExpr("length(masked)").collect()
    assert time.perf_counter() - began < 20
