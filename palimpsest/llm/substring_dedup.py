"""Substring dedup by difference-cover anchors.

A cover D modulo v holds two elements of every difference: for any two places i and j some d < v puts both i + d and j + d on
the cover. So two equal windows of W words share an anchor, a window of W - v + 1 words at a cover place, at equal distance
from their starts. Only anchors (a fraction |D| / v of all places) are hashed and counted over the corpus. A window that
holds a repeated anchor is a candidate; matches are then extended from the anchors by counting candidates' hashes of up to 96 bits.

Documents are dealt into shards of bounded size by a hash of doc_id. A shard gives each of its distinct hashes once, as a row
of its own, and gets back the numbers of those that stand elsewhere too: rows grow with the text, whatever the size of the
corpus, and a passage that stands in a third of all documents is one row a shard. Nothing is paired.

Defined results: null or empty texts have no words; places are counted within rows, so repeated rows repeat each other;
rows without doc_id are documents like others; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import text_bytes
from palimpsest.llm.words import Words

#: Perfect difference covers by modulus. Fixed values.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Text bytes of a shard, on average.
SHARD_BYTES = 2 << 20


def cover_for(window: int) -> int:
    """The largest modulus of at most three fifths of the window; windows under 5 words need no cover: every place is an anchor."""
    return max((v for v in COVERS if 5 * v <= 3 * window), default=1)


def hash_bits(places: int) -> tuple[int, int]:
    """Bits of an anchor's hash, and of a window's beyond 64, for so many places.

    Anchors only choose candidates: a thousand times the places are enough. Of windows no two may meet by chance: among all pairs of
    places that happens less than once in 2^20 such corpora, up to 2^38 places, and in 2^9 at 2^44, with 96 bits.
    """
    doublings = max(1, places).bit_length()
    return min(64, doublings + 10), min(32, max(1, 2 * doublings + 20 - 64))


class Shard:
    """Texts of one shard, the places that it asks about, and its distinct hashes (h1, h2), sorted."""

    def __init__(self, texts: pa.ChunkedArray, window: int, bits: tuple[int, int]):
        self.words, self.window, self.bits = Words(texts), window, bits
        self.v = cover_for(window)
        self.length = window - self.v + 1

    def anchors(self) -> None:
        words = self.words
        at = words.places(self.length)
        residue = (at - words.first[words.text_of(at)]) % self.v
        self.at = at[np.isin(residue, COVERS.get(self.v, (0,)))]
        self._set(words.runs(self.at, self.length) >> np.uint64(64 - self.bits[0]), None)

    def candidates(self, repeated: np.ndarray) -> None:
        """Windows that hold a repeated anchor among their first v places."""
        words = self.words
        edges = np.zeros(len(words) + 1, np.int32)
        at = self.at[repeated]
        np.add.at(edges, np.maximum(at - self.v + 1, 0), 1)
        np.add.at(edges, at + 1, -1)
        near = np.cumsum(edges[: len(words)]) > 0
        fits = words.places(self.window)
        self.at = fits[near[fits]]
        self._set(words.runs(self.at, self.window), words.runs(self.at, self.window, 1) >> np.uint64(64 - self.bits[1]))

    def _set(self, h1: np.ndarray, h2: np.ndarray | None) -> None:
        order = np.argsort(h1) if h2 is None else np.lexsort((h2, h1))
        h1 = h1[order]
        new = np.ones(len(h1), bool)
        new[1:] = h1[1:] != h1[:-1]
        if h2 is not None:
            h2 = h2[order]
            new[1:] |= h2[1:] != h2[:-1]
        where = np.flatnonzero(new)
        self.of = np.empty(len(h1), np.int64)  # the entry of each place
        self.of[order] = np.cumsum(new) - 1
        self.h1, self.h2 = h1[where], np.zeros(len(where), np.uint64) if h2 is None else h2[where]
        self.twice = np.diff(np.append(where, len(h1))) > 1

    def asked(self, name: int) -> pa.Table:
        """A row for each hash: shard, the entry's number times two, one more if the shard has it twice, h1 and h2."""
        n = len(self.h1)
        number = np.arange(n, dtype=np.int32) * 2 + self.twice
        columns = np.full(n, name, np.int32), number.astype(np.int32), self.h1.view(np.int64), self.h2.astype(np.uint32).view(np.int32)
        return pa.table([pa.array(c) for c in columns], names=["shard", "number", "h1", "h2"])

    def answered(self, answers: pa.Table) -> np.ndarray:
        """Which places are repeated in the corpus, from the numbers of entries that came back."""
        entry = self.twice.copy()
        entry[answers.column("entry").to_numpy()] = True
        return entry[self.of]


ASKED = "shard int, number int, h1 long, h2 int"


def _repeated(asked: DataFrame) -> DataFrame:
    """(shard, entry) of the hashes that another shard has too; what a shard has twice it knows itself."""
    twice = F.col("number").bitwiseAND(1)
    times = F.sum(twice + 1).over(Window.partitionBy("h1", "h2"))
    return asked.withColumn("times", times).where((F.col("times") > 1) & (twice == 0)).select("shard", F.shiftright("number", 1).alias("entry"))


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row: words covered by a window that also starts elsewhere are removed.

    Words are runs of other than ASCII white space; the kept ones are joined by one space.
    """
    size = text_bytes(docs, text_col)
    shards, bits = max(1, -(-size // shard_bytes)), hash_bits(size // 2)
    # A row of a doc_id that many rows share goes by its text too, so that a repeated id makes no large shard.
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(shards)).cast("int").alias("shard"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def first(table: pa.Table) -> pa.Table:
        shard = Shard(table.column("text"), window, bits)
        shard.anchors()
        return shard.asked(table.column("shard")[0].as_py())

    def windows_of(table: pa.Table, answers: pa.Table) -> Shard:
        shard = Shard(table.column("text"), window, bits)
        shard.anchors()
        shard.candidates(shard.answered(answers))
        return shard

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        return windows_of(table, answers).asked(table.column("shard")[0].as_py())

    def third(table: pa.Table, answers: pa.Table) -> pa.Table:
        about = answers.column("about").to_numpy()
        shard = windows_of(table, answers.filter(pa.array(about == 0)))
        found = shard.at[shard.answered(answers.filter(pa.array(about == 1)))]
        words = shard.words
        edges = np.zeros(len(words) + 1, np.int32)
        np.add.at(edges, found, 1)
        np.add.at(edges, found + window, -1)
        covered = np.cumsum(edges[: len(words)]) > 0
        before = np.concatenate(([0], np.cumsum(covered)))
        kept = pa.array(words.kept_texts(~covered), pa.binary()).cast(pa.string())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(words.counts(), pa.int64()), "n_removed": pa.array(np.diff(before[words.first]), pa.int64()), "kept_text": kept})

    by_shard = rows.groupBy("shard")
    anchors = _repeated(by_shard.applyInArrow(first, ASKED))
    windows = _repeated(by_shard.cogroup(anchors.groupBy("shard")).applyInArrow(second, ASKED))
    both = anchors.select("*", F.lit(0).alias("about")).unionAll(windows.select("*", F.lit(1).alias("about")))
    id_type = docs.schema[id_col].dataType.simpleString()
    return by_shard.cogroup(both.groupBy("shard")).applyInArrow(third, f"doc_id {id_type}, n_words long, n_removed long, kept_text string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
