"""Hard negatives by a block matrix product in two dimensions.

Vectors are quantised to integers and sharded: blocks of `block_rows` vectors, each cut into `chunks` ranges of dimensions, one row of a
written table for each block and range. Anchors are sharded likewise. A shard of vectors and a shard of anchors of the same range
give a partial tile of scores; a shuffle by tile brings its partial tiles together and adds them in 64-bit integers. Each tile is
then reduced, anchor by anchor: its best `positives` vectors of the anchor's label, and the vectors of other labels that may lie in
the window of one of the anchor's positives. Such a window begins at `low` percent of the positive's score, and no positive of the
whole table scores less than the tile's own last one, so what is below that percentage of it goes; where the tile has fewer
positives, what is below zero. Best positives over all tiles follow, then the best negatives of each tile within each window, then
those over all tiles.

Vectors themselves are never shuffled against each other: anchors go to the vectors' tasks in panels of at most `panel_bytes`, one
after another, each with tables of its own. Partial tiles travel as byte planes, compressed. Products run in double precision where
that is exact, else in 64-bit integers.

Defined results: rows without id or label, with a null vector, or with a null or non-finite component take no part, nor do those
with a component so large that a hundred times a score might not fit 64 bits; empty vectors score 0; vectors of different lengths
never meet; rows that share an id are one row, with the least label and then the least vector; an anchor without positives, or a
positive without negatives in its window, gives no rows; an empty table gives none; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import discard, materialise

_SHARD = pa.schema([("size", pa.int32()), ("block", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()), ("peak", pa.int64()), ("width", pa.int32()), ("data", pa.binary())])
_SHARD_DDL = "size int, block long, chunk int, n int, ids binary, labels binary, peak long, width int, data binary"
_TILE = pa.schema([("block", pa.int64()), ("anchors", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("anchor_ids", pa.binary()), ("anchor_labels", pa.binary()), ("width", pa.int32()), ("tile", pa.binary())])
_TILE_DDL = "block long, anchors long, ids binary, labels binary, anchor_ids binary, anchor_labels binary, width int, tile binary"
_FOUND_DDL = "anchor_id long, positives array<struct<score:bigint,id:bigint>>, negatives array<struct<score:bigint,id:bigint>>"
SCALE = 256


def usable(vectors: DataFrame, id_col: str, label: Column, vec_col: str) -> DataFrame:
    """(id, label, v) of the rows that take part, one for each id."""
    single = isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
    v = F.col(vec_col).cast("array<float>" if single else "array<double>")
    most = F.sqrt(F.lit(float(1 << 56)) / F.greatest(F.size(v), F.lit(1))) / SCALE - 1
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < most), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.struct(label.cast("long").alias("label"), v.alias("v")).alias("row")).where(F.col("id").isNotNull() & F.col("row.label").isNotNull() & F.col("row.v").isNotNull() & fine)
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v")


def narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them all."""
    most = int(np.abs(values).max(initial=0))
    return values.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")


def shards(rows: DataFrame, block_rows: int, chunks: int) -> DataFrame:
    """Blocks of quantised vectors, cut into ranges of dimensions. Ids and labels are with the first range."""

    def cut(number: int, ids: np.ndarray, labels: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = values.shape[1]
        order = np.argsort(ids)
        edges = np.linspace(0, size, chunks + 1).astype(int)
        for k in range(chunks):
            part = narrow(values[order, edges[k] : edges[k + 1]])
            named = [ids[order].astype("<i8").tobytes(), labels[order].astype("<i8").tobytes()] if k == 0 else [None, None]
            made = [size, number, k, len(ids), *named, int(np.abs(part.astype(np.int64)).max(initial=0)), part.itemsize, part.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(made, _SHARD)], schema=_SHARD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}
        for batch in batches:
            v = batch.column(2)
            sizes = pc.list_value_length(v).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                own = pa.array(np.flatnonzero(sizes == size))
                values = np.floor(SCALE * v.take(own).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
                new = [batch.column(0).take(own).to_numpy(), batch.column(1).take(own).to_numpy(), values.reshape(len(own), size)]
                have = [np.concatenate(x) for x in zip(held[size], new)] if size in held else new
                while len(have[0]) >= block_rows:
                    yield from cut(number, *(x[:block_rows] for x in have))
                    number, have = number + 1, [x[block_rows:] for x in have]
                held[size] = have
        for have in held.values():
            if len(have[0]):
                yield from cut(number, *have)
                number += 1

    return rows.mapInArrow(run, _SHARD_DDL)


def product(a: np.ndarray, b: np.ndarray, peaks: int) -> np.ndarray:
    """a times b transposed, in 64-bit integers; peaks: what no product of two of their components exceeds."""
    if peaks * max(a.shape[1], 1) < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def packed(tile: np.ndarray) -> tuple[int, bytes]:
    """Bytes a score, and the scores as compressed byte planes."""
    tile = narrow(tile)
    return tile.itemsize, pa.compress(np.ascontiguousarray(tile.reshape(-1).view(np.uint8).reshape(-1, tile.itemsize).T), "zstd", asbytes=True)


def unpacked(width: int, data: bytes, shape: tuple[int, int]) -> np.ndarray:
    n = shape[0] * shape[1]
    planes = np.frombuffer(pa.decompress(data, n * width, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<i{width}").reshape(shape).astype(np.int64)


def partial_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partial tile for each pair of shards. Names of rows and anchors are with the first range."""
    for batch in batches:
        for row in range(len(batch)):
            at = {name: batch.column(i)[row].as_py() for i, name in enumerate(batch.schema.names)}
            a, b = (np.frombuffer(at[d], f"<i{at[w]}") for d, w in (("data", "width"), ("anchor_data", "anchor_width")))
            a, b = a.reshape(at["n"], -1), b.reshape(at["m"], -1)
            width, tile = packed(product(a, b, at["peak"] * at["anchor_peak"]))
            made = [at["block"], at["anchors"], at["ids"], at["labels"], at["anchor_ids"], at["anchor_labels"], width, tile]
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(made, _TILE)], schema=_TILE)


def _lists(owner: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int, most: int | None = None) -> pa.Array:
    """For each of n owners the list of (score, id), best first."""
    order = np.lexsort((ids, -scores, owner))
    owner, scores, ids = owner[order], scores[order], ids[order]
    if most is not None:
        first = np.searchsorted(owner, owner)
        kept = np.arange(len(owner)) - first < most
        owner, scores, ids = owner[kept], scores[kept], ids[kept]
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(scores), pa.array(ids)], ["score", "id"]))


def reduced(positives: int, low: int):
    """A function of a tile's partial tiles that gives each anchor's best positives and possible negatives of the tile."""

    def run(table: pa.Table) -> pa.Table:
        names = next(r for r in table.select(["ids", "labels", "anchor_ids", "anchor_labels"]).to_pylist() if r["ids"] is not None)
        ids, labels, anchors, own = (np.frombuffer(names[c], "<i8") for c in ("ids", "labels", "anchor_ids", "anchor_labels"))
        shape = (len(ids), len(anchors))
        total = np.zeros(shape, np.int64)
        for width, tile in zip(table.column("width"), table.column("tile"), strict=True):
            total += unpacked(width.as_py(), tile.as_py(), shape)
        same = labels[:, None] == own[None, :]
        nothing = np.iinfo(np.int64).min
        fit = np.where(same & (ids[:, None] != anchors[None, :]), total, nothing)
        last = np.partition(fit, len(ids) - positives, axis=0)[len(ids) - positives] if len(ids) >= positives else np.full(len(anchors), nothing)
        row, anchor = np.nonzero((fit >= last) & (fit > nothing))
        best = _lists(anchor, total[row, anchor], ids[row], len(anchors), positives)
        floor = np.where(last > 0, low * np.maximum(last, 0), 0)
        row, anchor = np.nonzero(~same & (100 * total >= floor[None, :]))
        return pa.table({"anchor_id": anchors, "positives": best, "negatives": _lists(anchor, total[row, anchor], ids[row], len(anchors))})

    return run


def _panels(anchors: DataFrame, panel_bytes: int) -> list[DataFrame]:
    """Shards of anchors in parts of at most panel_bytes, or of a single block."""
    sized = anchors.select("block", (F.octet_length("data") + F.coalesce(F.octet_length("ids"), F.lit(0)) * 2 + 64).alias("n"))
    count, total = sized.agg(F.countDistinct("block"), F.sum("n")).first()
    n = -(-(total or 0) // panel_bytes)
    part = lambda k: F.pmod(F.xxhash64("block"), F.lit(k))
    while 1 < n < 4 * count:
        if sized.groupBy(part(n).alias("p")).agg(F.sum("n").alias("n")).where(F.col("n") > panel_bytes).isEmpty():
            break
        n *= 2
    return [anchors.where(part(n) == p) if n > 1 else anchors for p in range(n)]


def mine(
    vectors: DataFrame, is_anchor: str, id_col: str = "vec_id", label_col: str | Column = "label", vec_col: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_rows: int = 2048, block_anchors: int = 512, chunks: int = 2, panel_bytes: int = 8 << 20,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor: a condition on `id`. For each anchor, its best other rows of its label are its positives; for each of them, the
    best rows of other labels with a score of low to high percent of the positive's are its negatives.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, F.col(label_col) if isinstance(label_col, str) else label_col, vec_col)
    blocks = materialise(shards(rows, block_rows, chunks), "vectors")
    anchors = materialise(shards(rows.where(is_anchor), block_anchors, chunks), "anchors")
    out = None
    for panel in _panels(anchors, panel_bytes):
        right = panel.select("size", "chunk", F.col("block").alias("anchors"), F.col("n").alias("m"), *(F.col(c).alias(f"anchor_{c}") for c in ("ids", "labels", "peak", "width", "data")))
        pairs = blocks.join(F.broadcast(right), ["size", "chunk"])
        tiles = pairs.mapInArrow(partial_tiles, _TILE_DDL).groupBy("block", "anchors")
        found = materialise(tiles.applyInArrow(reduced(positives, low), _FOUND_DDL), "tiles")
        mined = _windows(found, positives, negatives, low, high)
        out = mined if out is None else out.unionAll(mined)
    discard(blocks, anchors)
    return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long") if out is None else out


def _windows(found: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    top = found.select("anchor_id", F.inline("positives")).withColumn("rank", best("anchor_id")).where(F.col("rank") <= positives)
    top = top.groupBy("anchor_id").agg(F.collect_list(F.struct("score", "id")).alias("best"))
    inside = lambda p: F.slice(F.filter("negatives", lambda n: (100 * n["score"] >= low * p["score"]) & (100 * n["score"] <= high * p["score"])), 1, negatives)
    near = found.where(F.size("negatives") > 0).select("anchor_id", "negatives").join(top, "anchor_id")
    near = near.select("anchor_id", F.inline(F.transform("best", lambda p: F.struct(p["id"].alias("positive_id"), p["score"].alias("positive_score"), inside(p).alias("near")))))
    near = near.select("anchor_id", "positive_id", "positive_score", F.inline("near"))
    ranked = near.withColumn("rank", best("anchor_id", "positive_id")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, "id % 100 = 0", label_col=label)


OP11_SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS r
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE r <= 5
"""
