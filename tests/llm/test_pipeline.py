"""Every row of every stage against a brute-force version on the stage's own input."""

import base64
import hashlib
import itertools
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from helpers import DOCS, near_by_force, odd_documents, slow_tiles, write_tables

from palimpsest.llm.quality import FEATURES, Indicators, fit

ITEM = [f"question{k}" for k in range(24)]


def documents():
    """Odd rows, poor ones, and ones that hold the benchmark's item: whole, in pieces, by more and by less than is allowed."""
    rng = random.Random(12)
    rows = odd_documents(seed=8, n=40)
    words = lambda n: [rng.choice(["meadow", "lantern", "Copper", "walked", "slowly", "under", "the", "bridge."]) for _ in range(n)]
    held = [ITEM, ITEM[16:] + ["and"] + ITEM[8:16] + ["or"] + ITEM[:8], ITEM[:20], ITEM[:19], [x.upper() for x in ITEM], [y for k in range(0, 24, 3) for y in [*ITEM[k : k + 3], "but"]]]
    rows += [(500 + k, " ".join([*words(40), *h, *words(30)]), "en", "held", 0) for k, h in enumerate(held)]
    rows += [(600 + k, " ".join(rng.choice(["BUY!!", "NOW!!", "$$$", "WIN#1"]) for _ in range(50)), "en", "poor", 0) for k in range(40)]
    rows += [(None, "no id at all, with a few words\nA line that many documents share.", None, None, None), (None, None, None, None, None)]
    return rows + rows[:6]


def slow_features(text):
    """Indicators by their definition, one n-gram after another."""
    data, out = (text or "").encode(), set()
    fold = lambda code, bits: (code * 2654435761 & 0xFFFFFFFF) >> bits
    for a, b, c in zip(data, data[1:], data[2:]):
        out.add(fold(a << 16 | b << 8 | c, 16))
    kind = lambda b: 1 if b >= 128 or 97 <= b <= 122 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b
    outline = [k for k, _ in itertools.groupby(map(kind, data))]
    for order in (1, 2, 3, 4, 6):
        for k in range(len(outline) - order + 1):
            code = order
            for symbol in outline[k : k + order]:
                code = code * 0x01000193 & 0xFFFFFFFF ^ symbol
            out.add((1 << 16) + fold(code, 18))
    words = data.split()
    same = [int(k > 0 and words[k] == words[k - 1]) for k in range(len(words))]
    for order in (1, 2, 4):
        for k in range(len(same) - order + 1):
            out.add((1 << 16) + (1 << 14) + (1 << order) + int("".join(map(str, same[k : k + order])), 2))
    return sorted(out)


def slow_quality(rows, model):
    for row in rows:
        found = slow_features(row[1])
        margin = model.weights[found].sum(dtype=np.float64) / max(model.square[found].sum(dtype=np.float64), 1e-12) ** 0.5 + model.bias
        if 1 / (1 + np.exp(-(model.curve[0] * margin + model.curve[1]))) >= 0.3:
            yield row


def slow_lines(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    name = lambda i: 2**63 if i is None else i
    holders = {}
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(name(i))
    for i, text, lang, source, _ in rows:
        kept = "\n".join(x for x in (text or "").split("\n") if len(key(x)) < 10 or name(i) == min(holders[key(x)]))
        yield i, kept, lang, source, len(kept)


def slow_near(rows):
    found = near_by_force(sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=str), 5, 80, 100)
    return [r for r in rows if r[0] is None or found[r[0]][2]]


def slow_clean(rows, items):
    words = lambda text: regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    for row in rows:
        text = words(row[1])
        held = set(text)
        for item in map(words, items):
            if item and sum(w in held for w in item) >= 0.8 * len(item) and sum(n for *_, n in slow_tiles(item, text, 3)) >= 0.8 * len(item):
                break
        else:
            yield row


def test_features_by_their_definition():
    rng = random.Random(4)
    texts = [None, "", "a", "ab", "a a a B b 11 1."] + ["".join(rng.choice("aab B1 .!\n\x85é\x1c") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    seen = Indicators(pa.array(texts, pa.string()))
    assert all(seen.of(i).tolist() == slow_features(t) and max(slow_features(t), default=0) < FEATURES for i, t in enumerate(texts))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = documents()
    labels = sorted({(r[0], int(r[3] != "poor"), 0) for r in rows if r[0] is not None and r[0] % 3})
    return write_tables(
        spark,
        tmp_path_factory.mktemp("pipeline"),
        documents=spark.createDataFrame(rows, DOCS),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, " ".join(ITEM)), (2, "Copper lantern"), (3, None), (4, "")], "item_id long, text string"),
    )


def test_stages_like_their_definitions(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    model = fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    by_force = {
        "quality": lambda rows: slow_quality(rows, model),
        "line_dedup": slow_lines,
        "near_dedup": slow_near,
        "decontaminate": lambda rows: slow_clean(rows, items),
    }
    ordered = lambda rows: sorted(rows, key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
        out = stage(spark, docs, tables)
        got = [tuple(r) for r in out.select(*corpus_pipeline.COLUMNS).collect()]
        assert ordered(got) == ordered(map(tuple, by_force[name](rows))), name
        assert got and ordered(got) != ordered(rows), f"{name} does nothing here"
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        ids = np.array(bpe.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    ran = [tuple(r) for r in corpus_pipeline.run(spark, tables).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert ordered(ran) == ordered(want)
