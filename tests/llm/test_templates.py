"""Near duplicates where a template is shared by very many texts that do not link, and the bound behind it."""

import random

from pyspark.sql import functions as F

from palimpsest.llm import near_dup
from palimpsest.llm.near_dup import near_duplicates, prefixes


def test_prefixes_are_long_enough():
    """Any two sets that link share a shingle of the smaller one's second prefix and the larger one's first."""
    for part, whole in ((80, 100), (85, 100), (90, 100), (100, 100)):
        for n in range(1, 120):
            for m in range(1, n + 1):
                common = -(-part * (n + m) // (part + whole))  # the least intersection that links
                if common > m:
                    continue
                search, by = n - -(-part * n // whole) + 1, m - -(-2 * part * m // (part + whole)) + 1
                # Whatever the order, of `common` shared shingles the first one stands at n - common + 1 and m - common + 1 at the latest.
                assert n - common + 1 <= search and m - common + 1 <= by


def test_prefixes_in_spark(spark):
    rows = spark.range(1, 400).select("id", *[c.alias(name) for share in ((80, 100), (85, 100)) for c, name in zip(prefixes(F.col("id"), share), (f"s{share[0]}", f"b{share[0]}"))]).collect()
    for r in rows:
        for part in (80, 85):
            assert (r[f"s{part}"], r[f"b{part}"]) == (r.id - -(-part * r.id // 100) + 1, r.id - -(-2 * part * r.id // (100 + part)) + 1)


def test_a_template_brings_nobody_together(spark, monkeypatch):
    """Hundreds of texts that share 160 of 184 words, and a few true near copies among them: only these meet."""
    rng, template = random.Random(1), [f"t{i}" for i in range(160)]
    texts = [(i, " ".join(template + [f"u{i}x{k}" for k in range(24)])) for i in range(600)]
    texts += [(1000 + i, texts[i * 7][1].replace(f"u{i * 7}x3", "other")) for i in range(12)]
    rng.shuffle(texts)
    seen, shared = [], near_dup._shared
    monkeypatch.setattr(near_dup, "_shared", lambda *a: seen.append(shared(*a)) or seen[-1])
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=3, share=(85, 100), node_limit=50, steps=2)
    assert {r.doc_id: r.component_id for r in got.where("NOT kept").collect()} == {1000 + i: i * 7 for i in range(12)}
    assert seen and seen[0].count() < 3000  # not 600 * 600 / 2, nor anything near it


def test_what_is_joined_is_not_searched(spark, monkeypatch):
    """A cluster of many blocks whose documents all link with its first one, and pairs: no search for shared shingles, no second look at small clusters."""
    rng, words = random.Random(2), [f"t{i}" for i in range(160)]
    texts = [(0, " ".join(words))] + [(i, " ".join([*words[:155], *(f"u{i}x{k}" for k in range(5))])) for i in range(1, 200)]
    texts += [(1000 + 10 * i + k, " ".join([f"p{i}x{j}" for j in range(99)] + [f"q{k}"])) for i in range(30) for k in range(2)]
    rng.shuffle(texts)
    looked, joined = [], near_dup.components
    monkeypatch.setattr(near_dup, "components", lambda edges: looked.append(edges.count()) or joined(edges))
    monkeypatch.setattr(near_dup, "_shared", None)
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), shingle=3, share=(85, 100), node_limit=50)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i // 10 * 10 if i >= 1000 else 0 for i, _ in texts}
    assert len(looked) == 2 and looked[1] == 199  # the great cluster's documents only
