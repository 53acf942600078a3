"""Empty tables, repeated rows, rows without id and clashing columns, for every operator and stage."""

import math
import random
import re

import corpus_pipeline
import pytest
from helpers import DOCS, odd_documents, write_tables
from pyspark.sql import functions as F

from palimpsest.llm import queries
from palimpsest.llm.common import components
from palimpsest.llm.line_dedup import dedup_lines
from palimpsest.llm.near_dup import near_duplicates
from palimpsest.llm.quality import fit, score
from palimpsest.llm.substring_dedup import dedup_substrings

SCHEMAS = {
    "documents": DOCS,
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


QUERIES = {"pipeline": corpus_pipeline.run, **queries.QUERIES}


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    folder = write_tables(spark, tmp_path, **{t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()})
    got = QUERIES[name](spark, folder)
    assert got.columns and got.count() == (1 if name.startswith("op2_") else 0)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows twice, rows without id, and columns named like those that operators add."""
    rows = odd_documents(seed=8, n=24)
    rows += [(None, "no id at all, with a few words", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows + rows[:6], DOCS)
    for name in ("id", "h1", "component", "shard", "n_lines", "kept_text", "score", "line_id", "rep"):
        df = df.withColumn(name, F.lit("mine"))
    return df.cache()


def test_lines(odd):
    out = dedup_lines(odd)
    assert out.count() == odd.count() and out.where("id <> 'mine' OR rep <> 'mine' OR h1 <> 'mine'").count() == 0
    assert out.where("doc_id = 0").select("kept_text").distinct().count() == 1


def test_near(odd):
    out = near_duplicates(odd)
    assert out.count() == odd.count()
    assert all(r.kept for r in out.where("doc_id IS NULL").collect())
    assert out.groupBy("doc_id").agg(F.countDistinct("component_id").alias("n")).where("n > 1").count() == 0


def test_substrings(odd):
    assert dedup_substrings(odd).count() == odd.count()


def test_scores(spark, odd):
    model = fit(odd, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    out = score(odd, model)
    assert out.count() == odd.count() and out.where("id <> 'mine'").count() == 0


def test_stages(spark, odd, tmp_path):
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(40)], SCHEMAS["labels"])
    item = odd.where("doc_id = 7").first().text
    benchmark = spark.createDataFrame([(1, item), (None, None)], SCHEMAS["benchmark"])
    folder = write_tables(spark, tmp_path, documents=odd, labels=labels, benchmark=benchmark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == before
            break
        assert out.columns == corpus_pipeline.COLUMNS, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.count() <= before
        if name == "near_dedup":
            assert docs.where("doc_id IS NULL").count() == 2
        if name == "decontaminate":
            assert docs.where("doc_id = 7").count() == 0
        before = docs.count()
    once = corpus_pipeline.near_dedup(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert once.where("doc_id = 24").count() == 0 and once.where("doc_id = 0").count() == 2
    ran = corpus_pipeline.run(spark, folder)
    assert sorted(r.doc_id or -99 for r in ran.collect()) == sorted(r.doc_id or -99 for r in docs.collect())


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(5, 10), (100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 5 for k in [5, *range(10, 41)]}, 100: 100, 101: 100, 200: 200, 300: 200, 250: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n, rule", [(100, "rising"), (1000, "falling"), (1000, "shuffled"), (100_000, "rising")])
def test_components_of_a_chain(spark, n, rule, caplog):
    """Rounds grow as the logarithm of a chain's length, whatever the order of its ids."""
    names = list(range(n)) if rule == "rising" else list(range(n, 0, -1)) if rule == "falling" else random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    with caplog.at_level("INFO"):
        out = components(edges)
    assert (out.count(), out.where(f"component <> {min(names)}").count()) == (n, 0)
    assert int(re.search(r"components: (\d+) rounds", caplog.text)[1]) <= 3 * math.log2(n)


def test_components_of_stars(spark, caplog):
    """Stars around their smallest ids, several at each vertex: a few rounds, however many leaves they have."""
    edges = [(v, v - v % n) for n in (300, 500, 3000) for v in range(1, 6000) if v % n]
    with caplog.at_level("INFO"):
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: v - v % 3000 for v in range(6000)}
    assert int(re.search(r"components: (\d+) rounds", caplog.text)[1]) <= 2
