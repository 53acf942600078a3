"""Line dedup against levelled sorted runs of line hashes.

The index is a log-structured merge tree whose runs are tables bucketed and sorted by a 128-bit hash of the line key.
A new batch is reduced to (hash, smallest document), merge-anti-joined with every run, and what is left becomes a run of
level 0. When a level holds `fanout` runs they are merged into one run of the next level, so that a batch meets
O(fanout * log(batches)) runs. Runs are never reshuffled by a batch: buckets line up with the batch's exchange.

Only DataFrame and SQL functions are used.

Defined results: a null or empty text is one empty line; an empty table gives no rows; rows that share a doc_id belong to
one document and never drop each other's lines; rows without doc_id together are the last document; other columns, whatever
their names, are left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import NO_ID, discard, fresh, materialise, partitions, remove, temporary_path

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


class LineIndex:
    """Which line keys have been seen. Batches must come in ascending order of their documents' ids."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or partitions(spark)
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _run(self, rows: DataFrame) -> str:
        """A table in the shared folder, whatever the warehouse is."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = temporary_path(self.spark, "line-run")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("compression", "zstd").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def compact(self) -> None:
        for level in range(len(self.levels)):
            runs = self.levels[level]
            if len(runs) < self.fanout:
                continue
            merged = self.spark.table(runs[0])
            for name in runs[1:]:
                merged = merged.unionAll(self.spark.table(name))  # keys of runs are disjoint
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._run(merged.repartition(self.buckets, "h1", "h2")))
            self.levels[level] = []
            self._drop(runs)

    def add(self, lines: DataFrame) -> DataFrame:
        """lines (h1, h2, id, ...) of a batch; the rows of its lines that were seen before, in an earlier batch or a smaller id."""
        self.compact()
        new = lines.groupBy("h1", "h2").agg(F.min("id").alias("id"))
        for runs in self.levels:
            for name in runs:
                new = new.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(run := self._run(new))
        # With the owner among the keys a very common line has no hot partition.
        return lines.join(self.spark.table(run).hint("merge"), ["h1", "h2", "id"], "left_anti")

    def drop(self) -> None:
        self._drop([name for runs in self.levels for name in runs])
        self.levels = [[]]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs with three more columns: n_lines, n_dropped (long) and kept_text, the text without lines that a smaller id holds.

    A line is compared by its key: stripped of ASCII white space, A-Z lower-cased; keys under min_chars code points stay.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    key, mark = fresh(docs, "line_id"), fresh(docs, "line_text_hash")
    docs = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))

    bounds = docs.select(key).approxQuantile(key, [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = F.lit(0)
    for bound in sorted(set(bounds)):
        batch = batch + (F.col("id") > F.lit(int(bound))).cast("int")
    exploded = docs.select(F.col(key).alias("id"), F.col(mark).alias("mark"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keyed = exploded.select("id", "mark", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    rows = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "id", "mark", "pos", batch.alias("batch"))
    rows = materialise(rows, "lines", ["batch"])

    index, gone = LineIndex(spark, fanout), None
    try:
        for b in range(len(set(bounds)) + 1):
            seen = materialise(index.add(rows.where(F.col("batch") == b)).select("id", "mark", "pos"), "seen")
            gone = seen if gone is None else gone.unionAll(seen)
    finally:
        index.drop()
    discard(rows)
    gone = gone.groupBy("id", "mark").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("id").alias(key), F.col("mark").alias(mark), F.col("gone").alias(g := fresh(docs, "line_gone")))

    none = F.array().cast("array<int>")
    lines = lines_of(F.col(text_col))

    def without(all_lines: Column) -> Column:
        """Positions that stay, by hash; then their lines. The lines are bound once, not split again for each position."""
        stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(g))
        return F.struct(F.size(all_lines).cast("long").alias("n"), F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n").alias("kept"))

    whole = F.struct(F.size(lines).cast("long").alias("n"), F.coalesce(F.col(text_col), F.lit("")).alias("kept"))
    done = fresh(docs, "line_done")
    out = docs.join(gone, [key, mark], "left").withColumn(done, F.when(F.col(g).isNull(), whole).otherwise(F.transform(F.array(lines), without)[0]))
    return out.select(
        *[c for c in docs.columns if c not in (key, mark)],
        F.col(f"{done}.n").alias("n_lines"),
        F.size(F.coalesce(F.col(g), none)).cast("long").alias("n_dropped"),
        F.col(f"{done}.kept").alias("kept_text"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, line, i, lower_az(line) AS key FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents)
), firsts AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key
), judged AS (
  SELECT l.doc_id, l.i, l.line, coalesce(f.owner <> l.doc_id, false) AS gone
  FROM lines l LEFT JOIN firsts f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""".replace(
    "lower_az(line)",
    "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')",
)
