"""Embedding near duplicates by sorted projection passes.

Each pass hashes unit vectors by the signs of random projections, one bit after the other, and sorts ids lexicographically by the
concatenated bits. Vectors that are close share a long prefix with good probability and stand close in the order. The order is
cut into blocks of `block` rows; each vector is compared with those of its own block and of the two beside it, across the
bounds of partitions too. So that a crowded stretch of the order loses nothing, stretches of one prefix of `prefix_bits` bits
that reach further are compared block against block besides, each pair of blocks by itself.

Only (id, key) is sorted. Vectors then go to their blocks, `run` blocks and the next one to a task, with where they stood in
earlier passes: a pair counts in the first pass in which it meets, so pairs need not be written out to be told apart. A task gives
each vector's number of new links and a spanning forest of them. Comparison is in single precision, and again in double
precision within 1e-4 of the threshold.

Equal vectors are one class, compared once; their links among each other follow from its size.

Defined results: null, empty, zero or non-finite vectors, or ones with a null or non-finite component, link with nothing; nor do
vectors of different lengths; rows without vec_id are left out of linking and come back with null component; rows that share
an id are one vector, linked with what any of them links, n_links being that of the one with most; an empty table gives no rows;
labels and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import components, discard, materialise, whole_groups

#: Share of pairs at the threshold that may share no prefix in any pass.
MISS = 1e-4
#: Single precision is trusted this far from the threshold; pairs that are looked at again at once.
CLOSE, PAIRS = 1e-4, 1 << 16


def directions(passes: int, bits: int, size: int) -> np.ndarray:
    """Random directions (passes, bits, size), the same on every executor."""
    return np.random.default_rng(20240229).standard_normal((passes, bits, size))


def _unit(vectors: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        vectors = vectors.astype(np.float64)
        scale = np.abs(vectors).max(axis=1, keepdims=True)
        vectors = vectors / np.where(scale > 0, scale, 1)
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def _component(vectors: DataFrame, vec_col: str) -> np.dtype:
    """Vectors travel as they come: in single precision if that is what they hold."""
    single = isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
    return np.dtype("<f4" if single else "<f8")


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector binary) of the rows that can link."""
    kind = _component(vectors, vec_col)
    v = F.col(vec_col).cast("array<float>" if kind.itemsize == 4 else "array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            ends = (np.concatenate(([0], np.cumsum(sizes))) * kind.itemsize).astype(np.int32)
            data = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            made = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["id", "vector"])

    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).mapInArrow(run, "id long, vector binary")


def _matrix(raw: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _keys(kind: np.dtype, passes: int, bits: int):
    """(id, size, pass, key) of each vector in each pass: key's bits in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column(1).to_pylist()
            lengths = np.array([len(x) // kind.itemsize for x in raw])
            for size in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == size)
                unit = _unit(_matrix([raw[i] for i in own.tolist()], kind))
                if size not in made:
                    made[size] = directions(passes, bits, size)
                ids, n = batch.column(0).take(pa.array(own)), len(own)
                for p in range(passes):
                    signs = (unit @ made[size][p].T >= 0).astype(np.int64)
                    key = (signs << np.arange(bits - 1, -1, -1, dtype=np.int64)).sum(axis=1, dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, p, np.int32)), pa.array(key)], names=["id", "size", "pass", "key"])

    return run


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of each pair of places; label holds a place of each place's tree, its own for roots."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, above := label[label]):
            label[:] = above


class Cell:
    """Vectors of one task's blocks, their links found so far, and a forest of them."""

    def __init__(self, table: pa.Table, kind: np.dtype, cosine: float):
        unit = _unit(_matrix(table.column("vector").to_pylist(), kind))
        self.exact, self.rough, self.cosine = unit, unit.astype(np.float32), cosine
        self.copies = table.column("copies").to_numpy()
        spots = table.column("spots").combine_chunks()
        self.spots = spots.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1, 2)  # earlier passes: prefix, block
        self.links = np.zeros(len(table), np.int64)
        self.label = np.arange(len(table))

    def compare(self, x: np.ndarray, y: np.ndarray | None = None) -> None:
        """All pairs within the places x, or between x and y, that met in no earlier pass."""
        likeness = self.rough[x] @ self.rough[x if y is None else y].T
        near = likeness >= self.cosine - CLOSE
        i, j = np.nonzero(np.triu(near, 1) if y is None else near)
        unsure = likeness[i, j] < self.cosine + CLOSE
        i, j = x[i], (x if y is None else y)[j]
        for q in range(self.spots.shape[1]):
            if not len(i):
                return
            one, two = self.spots[i, q], self.spots[j, q]
            new = (one[:, 0] != two[:, 0]) & (np.abs(one[:, 1] - two[:, 1]) > 1)
            i, j, unsure = i[new], j[new], unsure[new]
        sure = ~unsure
        check = np.flatnonzero(unsure)
        for s in range(0, len(check), PAIRS):
            part = check[s : s + PAIRS]
            sure[part] = np.einsum("ij,ij->i", self.exact[i[part]], self.exact[j[part]]) >= self.cosine
        i, j = i[sure], j[sure]
        np.add.at(self.links, i, self.copies[j])
        np.add.at(self.links, j, self.copies[i])
        _merge(self.label, i, j)


def _compare(kind: np.dtype, cosine: float, run_of: int):
    """(id, links, toward) of each vector that has new links in a cell: how many, and another one of its tree.

    A cell holds the blocks of one run and the first of the next, or two blocks of a crowded stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "cell"):
            ids = table.column("id").to_numpy()
            block, crowded = table.column("block").to_numpy(), table.column("crowded").to_numpy(zero_copy_only=False)
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s < 2:
                    continue
                own = block[s:e]
                names, starts = np.unique(own, return_index=True)  # rows come in order of blocks
                parts = np.split(np.arange(e - s), starts[1:])
                cell = Cell(table.slice(s, e - s), kind, cosine)
                if crowded[s]:
                    if len(parts) == 2:
                        cell.compare(parts[0], parts[1])
                else:
                    first = names[0] // run_of
                    for k, name in enumerate(names.tolist()):
                        if name // run_of == first:
                            cell.compare(parts[k])
                            if k + 1 < len(names) and names[k + 1] == name + 1:
                                cell.compare(parts[k], parts[k + 1])
                met = np.flatnonzero(cell.links)
                if len(met):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][met]), pa.array(cell.links[met]), pa.array(ids[s:e][cell.label[met]])], names=["id", "links", "toward"])

    return run


def new_links(classes: DataFrame, kind: np.dtype, cosine: float, passes: int, bits: int, prefix_bits: int, block: int, run: int) -> DataFrame:
    """(id, links, toward) rows from all passes for classes (id, vector, copies): links add up, (id, toward) join what links join."""
    keys = classes.select("id", "vector").mapInArrow(_keys(kind, passes, bits), "id long, size int, pass int, key long")
    order = ("size", "pass", "key", "id")
    # Partitions of a range hold rows in order, and so do the numbers that rows get in them.
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    prefix = F.shiftright("key", bits - prefix_bits).cast("int")
    place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    placed = materialise(ordered.select("id", "size", "pass", prefix.alias("prefix"), F.shiftright("place", 33).cast("int").alias("part"), F.floor(place / block).cast("int").alias("nth")), "placed")
    # One row for each partition and pass that it holds some of.
    parts = placed.groupBy("size", "pass", "part").agg(F.min("nth").alias("low"), (F.max("nth") - F.min("nth") + 1).alias("n"))
    before = Window.partitionBy("size", "pass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("size", "pass", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    block_of = (F.col("nth") + F.col("shift")).cast("int").alias("block")
    placed_all = materialise(placed.join(parts, ["size", "pass", "part"]).select("id", "size", "pass", "prefix", block_of), "blocks")
    spots = placed_all.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pass", "prefix", "block"))).alias("at"))  # one entry a pass
    vectors = materialise(classes.join(spots, "id").select("id", "copies", "vector", "at"), "spots")

    # Of earlier passes: prefix and block, one after the other.
    told = lambda p: F.flatten(F.transform(F.slice("at", 1, p), lambda x: F.array(x["prefix"], x["block"]))).alias("spots")
    size = F.octet_length("vector")
    here = vectors.select("id", "copies", "vector", "at", F.explode("at").alias("now"))
    nth_run = F.floor(F.col("now.block") / run).cast("int")
    runs = F.when((F.col("now.block") % run == 0) & (F.col("now.block") > 0), F.array(nth_run, nth_run - 1)).otherwise(F.array(nth_run))
    here = here.withColumn("of", F.explode(runs))
    cells = here.select(F.xxhash64(size, F.col("now.pass"), "of").alias("cell"), F.col("now.block").alias("block"), F.lit(False).alias("crowded"), "id", "copies", "vector", told(F.col("now.pass")))

    wide = placed_all.groupBy("size", "pass", "prefix").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("high - low > 1")
    far = placed_all.join(wide, ["size", "pass", "prefix"]).withColumn("other", F.explode(F.sequence("low", "high"))).where("abs(other - block) > 1")
    far = far.join(vectors.select("id", "copies", "vector", "at"), "id")
    two = F.xxhash64("size", "pass", "prefix", F.least("block", "other"), F.greatest("block", "other"))
    far = far.select(two.alias("cell"), "block", F.lit(True).alias("crowded"), "id", "copies", "vector", told(F.col("pass")))
    found = cells.unionAll(far).repartition("cell").sortWithinPartitions("cell", "block", "id").mapInArrow(_compare(kind, cosine, run), "id long, links long, toward long")
    found = materialise(found, "links")
    discard(placed, placed_all, vectors)
    return found


def near_vectors(vectors: DataFrame, cosine: float = 0.95, passes: int | None = None, bits: int = 48, prefix_bits: int | None = None, block: int = 1024, run: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    prefix_bits grows as log2 of the number of vectors, so that a stretch of unrelated ones fills about a block; passes, unless
    given, are so many that a pair at the threshold shares no prefix in any of them once in 1 / MISS times.
    """
    kind = _component(vectors, vec_col)
    good = materialise(usable(vectors, id_col, vec_col), "vectors")
    classes = good.groupBy("vector").agg(F.countDistinct("id").alias("copies")).withColumn("class", F.monotonically_increasing_id())
    classes = materialise(classes, "vector-classes")
    if prefix_bits is None:
        prefix_bits = min(bits, 31, max(4, (classes.count() // block).bit_length()))
    if passes is None:
        together = (1 - np.arccos(cosine) / np.pi) ** prefix_bits
        passes = max(1, int(np.ceil(np.log(MISS) / np.log1p(-together))))
    member = materialise(good.join(classes, "vector").select("id", "class", "copies").distinct(), "members")
    found = new_links(classes.select(F.col("class").alias("id"), "vector", "copies"), kind, cosine, passes, bits, prefix_bits, block, run)
    discard(good, classes)

    links = found.groupBy(F.col("id").alias("class")).agg(F.sum("links").alias("others"))
    several = member.groupBy("id").agg(F.min("class").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same_id = member.join(several, "id").where("class <> a").select("a", F.col("class").alias("b"))
    joined = components(found.where("id <> toward").selectExpr("id a", "toward b").unionAll(same_id)).withColumnRenamed("id", "class")
    judged = member.join(links, "class", "left").join(joined, "class", "left").withColumn("tree", F.coalesce("component", "class"))
    judged = materialise(judged.select("id", "tree", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "judged")
    judged = judged.join(judged.groupBy("tree").agg(F.min("id").alias("component_id")), "tree")
    judged = judged.groupBy("id", "component_id").agg(F.max("n_links").alias("n_links"))
    discard(found, member)
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(judged, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
