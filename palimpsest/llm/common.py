"""What the operators share: scratch tables in the cluster's shared folder, components, grouped streams."""

from __future__ import annotations

import logging
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null doc_id inside an operator: all rows without an id are one document, the last.
NO_ID = 2**63 - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master, as in tests, gets one of our own without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.gettempdir()}/palimpsest-scratch"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/palimpsest/{what}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def temporary_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder for what goes when the application ends, at the latest."""
    path = scratch_path(spark, what)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    return path


def materialise(df: DataFrame, what: str, partition_by: list[str] | None = None, path: str | None = None, options: dict | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again. Cuts lineage and survives lost executors.

    The table goes by discard(), at the latest when the application ends; one with a path of the caller's own stays.
    """
    spark = df.sparkSession
    if path is None:
        path = temporary_path(spark, what)
    writer = df.write.option("compression", "zstd").options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # Parquet has no required columns on the way back.
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables of materialise() that no plan will read again."""
    for df in tables:
        remove(df.sparkSession, df.scratch_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def fresh(df: DataFrame, name: str) -> str:
    """name, or a variant that is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph with long columns (a, b).

    Returns (id, component) for each vertex that has an edge; component is the smallest vertex that can be reached.
    Contraction: in each round every vertex points at the first of itself and its neighbours, the edges move to the vertices
    pointed at, loops go. Vertices are ordered by id as long as a round leaves at most half of the edges: stars around their
    smallest vertex, which callers mostly bring, go at once. From then on each round has a random order of its own, and on any
    graph leaves at most three quarters of the vertices on average. So rounds grow as the logarithm of the graph's size. Only
    aggregates and joins on vertex ids: nothing is gathered.
    """
    spark = edges.sparkSession
    cur = materialise(edges.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct(), "edges")
    maps: list[DataFrame] = []
    left, by_id = cur.count(), True
    while left:
        ranked = lambda v: F.struct(F.xxhash64(F.lit(len(maps)), F.col(v)).alias("rank"), F.col(v).alias("v"))
        both = cur.select("a", "b").unionAll(cur.selectExpr("b a", "a b")).groupBy(F.col("a").alias("id"))
        if by_id:
            parent = both.agg(F.min("b").alias("first")).select("id", F.least("first", "id").alias("parent"))
        else:
            parent = both.agg(F.min(ranked("b")).alias("first")).select("id", F.least("first", ranked("id"))["v"].alias("parent"))
        parent = materialise(parent, "parents")
        moved = (
            cur.join(parent.selectExpr("id a", "parent pa"), "a")
            .join(parent.selectExpr("id b", "parent pb"), "b")
            .where("pa <> pb")
            .selectExpr("least(pa, pb) a", "greatest(pa, pb) b")
            .distinct()
        )
        maps.append(parent)
        moved = materialise(moved, "edges")
        discard(cur)
        cur, before, left = moved, left, moved.count()
        by_id = by_id and 2 * left <= before
    discard(cur)
    logging.getLogger(__name__).info("components: %d rounds", len(maps))
    if not maps:
        return spark.createDataFrame([], "id long, component long")
    out = maps[-1].selectExpr("id", "parent root")
    for parent in reversed(maps[:-1]):
        later = out.selectExpr("id parent", "root")
        out = parent.join(later, "parent", "left").selectExpr("id", "coalesce(root, parent) root")
    out = materialise(out, "roots")
    discard(*maps)
    if by_id:  # the smallest vertex has only ever pointed at itself
        return out.withColumnRenamed("root", "component")
    return out.join(out.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by a long key: tables in which every key is complete, and the row at which each key starts, with the end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        if cut:
            held.append(batch.slice(0, cut))
        elif held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        if held:
            yield _with_starts(held, key)
        held = [batch.slice(cut)]
    if held:
        yield _with_starts(held, key)


def _with_starts(held: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    keys = table.column(key).to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return table, np.concatenate((starts, [len(keys)]))
