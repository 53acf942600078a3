"""Ranked lexical search against its definition, and block boundaries against all ways to cut."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import odd_documents
from pyspark.sql import functions as F

from palimpsest.llm import lexical_search
from palimpsest.llm.lexical_search import cut, search, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_force(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for item in {i for i, _ in items}:
        wanted = Counter(t for text in {t for i, t in items if i == item} for t in terms_of(text))
        scored = []
        for doc, c, size in held:
            m = 75 + 25 * size * n // total
            s = sum(often * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t, often in wanted.items() if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc if doc is not None else 0, doc))
        for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1):
            out[item, r] = (doc, -s)
    return out


def test_search_equals_brute_force(spark):
    docs = [(i, t) for i, t, *_ in odd_documents(n=80)]
    docs += [(7, docs[7][1]), (None, docs[3][1]), (None, "alone"), (200, "Ünïcode ẞ x_y-z 3rd 3RD"), (201, "a" * 70_000 + " " + docs[5][1])]
    items = [(0, docs[4][1]), (1, docs[5][1][:80]), (1, docs[6][1][:60]), (1, docs[5][1][:80]), (2, "3rd 3RD x Y"), (3, None), (4, ""), (5, "nosuchterm"), (None, "alone same one"), (6, " ".join([docs[9][1]] * 3))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' doc_id", "1 score")
    for size, block in ((16 << 20, 8 << 20), (4_000, 300)):
        got = search(frame, asked, k=7, shard_bytes=size, block_bytes=block).collect()
        found = {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got}
        assert len(found) == len(got) and found == by_force(docs, items, 7)
    assert search(frame.limit(0), asked).count() == 0 and search(frame, asked.limit(0)).count() == 0
    assert search(frame.where("text = '' OR text IS NULL"), asked).count() == 0
    assert [(f.name, f.dataType.simpleString()) for f in search(frame, asked).schema] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_skips_and_ties(spark):
    """Thousands of documents in one shard: many ties, thresholds that skip most blocks."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    docs = [(i * 3 % 4001, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(60)], k=rng.choice([3, 3, 9, 40])))) for i in range(4000)]
    items = [(0, "w0 w1 w59"), (1, "w58 w57 w3 w3"), (2, " ".join(words)), (3, "w0")]
    got = search(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got.collect()} == by_force(docs, items, 20)


def test_rounds_leave_stretches_out(monkeypatch):
    """Of a list with one high stretch, only a part is scored."""
    n = 5000
    often = np.ones(n, np.int64)
    often[4000:4030] = 50
    shard = {"ids": np.arange(n).astype("<i8").tobytes(), "sizes": np.full(n, 60).astype("<i8").tobytes(), "terms": pa.array(["x"]), "starts": np.array([0, n]).astype("<i8").tobytes(), "docs": np.arange(n).astype("<i4").tobytes(), "counts": often.astype("<i8").tobytes()}
    lists = lexical_search.Lists(shard, pa.array(["x"]), np.array([500]), n, 60 * n)
    seen = []
    scored = lists._scored
    monkeypatch.setattr(lists, "_scored", lambda *a: seen.append(len(a[2])) or scored(*a))
    scores, ids = lists.search(np.array([0]), np.array([1]), 20, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert ids.tolist() == list(range(4000, 4020)) and sum(seen) < len(lists.top)


def test_cut_is_least(n=14, grain=2, reach=4, price=1.5):
    rng = np.random.default_rng(3)
    lists = [rng.integers(1, 100, size) for size in (n, 1, 3, 9, 13)]
    got = cut(np.array([len(x) for x in lists]), np.concatenate(lists), grain, reach, price)

    def error(x, opens):
        ends = [*opens[1:], len(x)]
        return sum((x[s:e].max() - x[s:e]).sum() + price * x.max() for s, e in zip(opens, ends))

    at = 0
    for x in lists:
        own = [int(o) - at for o in got if at <= o < at + len(x)]
        inner = range(grain, len(x), grain)
        ways = ([0, *c] for r in range(len(inner) + 1) for c in itertools.combinations(inner, r))
        fits = [w for w in ways if all(-(-(e - s) // grain) <= reach for s, e in zip(w, [*w[1:], len(x)]))]
        assert own[0] == 0 and np.isclose(error(x, own), min(error(x, w) for w in fits))
        at += len(x)


def test_terms_in_chunks(monkeypatch):
    monkeypatch.setattr(lexical_search, "_CHUNK", 16)
    texts = ["A bc, d-é_f \U0001f600 bc", None, "", "x" * 100 + " y" * 30, "\x7f\x00[]"]
    found = Counter()
    for terms, term, doc, often in term_counts(pa.array(texts)):
        for t, d, c in zip(term.tolist(), doc.tolist(), often.tolist()):
            found[d, terms[t].as_py()] += c
    assert found == Counter({(i, t): c for i, x in enumerate(texts) for t, c in Counter(terms_of(x)).items()})


def test_rows_of_the_index_are_small(spark):
    """Shards that come to one task are never one row or one batch: a row is one term's list, and of few documents."""
    docs = [(i, f"every word w{i} of {i % 7}") for i in range(500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = lexical_search.index(frame, shard_docs=100)
    assert rows.where("term IS NULL").count() == 5 and rows.agg(F.max(F.octet_length("docs"))).first()[0] <= 800
    assert rows.where("term = 'every'").agg(F.count("df"), F.sum("df")).first()[:] == (5, 500)
    items = [(0, "every w3 6"), (1, "w77 of")]
    got = search(frame, spark.createDataFrame(items, "item_id long, text string"), shard_docs=100)
    assert {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in got.collect()} == by_force(docs, items, 20)
