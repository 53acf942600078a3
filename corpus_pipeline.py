"""The corpus pipeline: five stages from raw documents to token ids.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

* quality: documents that the quality classifier rejects go.
* line_dedup: lines that a smaller doc_id holds go from the text; n_chars follows.
* near_dedup: one document of each group of near duplicates stays, the smallest doc_id.
* decontaminate: documents that hold a benchmark item go.
* encode: token ids of each text, digested, and of the text decoded from them.

Documents without doc_id go through: they are judged by text alone, and link with nothing. Repeated rows of one doc_id share
their fate. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.byte_bpe import encode_digests
from palimpsest.llm.common import discard, materialise
from palimpsest.llm.decontaminate import contaminated
from palimpsest.llm.line_dedup import dedup_lines
from palimpsest.llm.near_dup import near_duplicates
from palimpsest.llm.quality import fit, score
from palimpsest.sources.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = dedup_lines(docs.select(*COLUMNS))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    gone = near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    held = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select(*COLUMNS).join(held.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return encode_digests(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: SQL expresses neither the classifier nor the tiling. tests/llm/test_pipeline.py holds every row of every stage, on that stage's
#: own input, against brute-force versions, with the parameters used here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
