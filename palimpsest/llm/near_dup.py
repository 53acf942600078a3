"""Near duplicates by a chosen-path set similarity join.

A document's set holds hashes of its distinct word shingles. Documents with equal sets collapse to the smallest id, so copies
cost nothing further. Representatives get minwise tokens and a sketch (256 one-byte minwise values). In each of `trees`
independent trees a path starts with one minwise token; a node that still holds more than `node_limit` documents branches
on one more token, up to `steps` in all. No token serves
twice, in one path or in two trees, so a pair of similarity s stays together over a step with probability s whatever happened
elsewhere, and misses every tree with probability (1 - s^steps)^trees at most. No path is longer than `steps`, however large the
table or a group of look-alikes: `trees` follows from the threshold and `steps`, so that under `MISS` of pairs at the threshold are missed.

Small nodes are compared exhaustively by sketch, 4.5 standard deviations below the threshold; a node yields a spanning forest
of its look-alikes, never its pairs. What is still large after the last step counts as look-alikes without comparison. Connected
components of all this are clusters: no link leaves a cluster. Links are decided on exact counts of full sets, for every
cluster alike. A cluster of up to `node_limit` documents and `block_bytes` is compared within one task, which names its groups for
good. A larger one is dealt into blocks, each compared within itself and with the cluster's first document, so that near copies
join at once; after that, where a cluster is not one group yet, documents that are not joined meet where they share one of their
rarest shingles (see prefixes), which all that link do and what merely has a template in common does not.

Defined results: texts without words and rows without doc_id link with nothing (the latter get a null component and stay);
repeated rows share their result, and rows that share a doc_id but not their text are each judged by their text; a document with fewer words than a shingle has its whole sequence as the only one;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import components, discard, materialise, whole_groups
from palimpsest.llm.words import Words, mixed, portions

SKETCH = 256
#: Share of pairs at the threshold that may meet in no tree.
MISS = 1e-4


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    return (seeds[::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[1::2] >> np.uint64(32)).astype(np.uint32)


def trees_for(similarity: float, steps: int) -> int:
    """How many trees of paths of at most `steps` tokens miss under MISS of the pairs of this similarity."""
    met = similarity**steps
    return 1 if met >= 1 else int(np.floor(np.log(MISS) / np.log1p(-met))) + 1


def shingle_sets(texts: pa.Array | pa.ChunkedArray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text, words with A-Z lower-cased."""
    words = Words(texts, lower=True)
    counts = words.counts()
    at = words.places(size)
    full = words.runs(at, size)
    bounds = np.searchsorted(at, words.first)
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= size:
            out.append(np.unique(full[bounds[i] : bounds[i + 1]]))
        elif n:
            out.append(words.runs(words.first[i : i + 1], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minwise(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The smallest value of each of the hash functions over a set."""
    by, plus = functions
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(by), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        values = by[:, None] * h[None, at : at + 512]
        values += plus[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def features(docs: DataFrame, size: int, n_tokens: int) -> DataFrame:
    """(id, n, h1, h2, tokens, sketch) of each row: size and 128-bit hash of its set, and its minwise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        functions = _constants(n_tokens + SKETCH)
        for batch in batches:
            counts, first, second, tokens, sketches = [], [], [], [], []
            for s in (s for part in portions(batch.column(1)) for s in shingle_sets(part, size)):
                counts.append(len(s))
                first.append(int(mixed(s).sum(dtype=np.uint64)))
                second.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                m = minwise(s, functions)
                tokens.append(m[:n_tokens].tobytes())
                low = m[n_tokens:]
                sketches.append((low ^ low >> np.uint32(15)).astype(np.uint8).tobytes())
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (first, second)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *longs, pa.array(tokens, pa.binary()), pa.array(sketches, pa.binary())], names=["id", "n", "h1", "h2", "tokens", "sketch"])

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long, tokens binary, sketch binary")


def _roots(trees: int, steps: int):
    """(id, tree, node) of each document: the first step of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, trees * steps)
            tree = np.tile(np.arange(trees), len(tokens))
            node = mixed(tokens[:, ::steps].astype(np.uint64).ravel() | tree.astype(np.uint64) << np.uint64(32))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), trees)), pa.array(tree, pa.int32()), pa.array(node.view(np.int64))], names=["id", "tree", "node"])

    return run


def _branch(trees: int, steps: int, step: int):
    """Children of nodes of (id, tree, node, tokens): each step of a tree has a token of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, node = batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            tokens = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, trees * steps)
            child = mixed(node + mixed(tokens[np.arange(len(node)), tree * steps + step].astype(np.uint64) + np.uint64(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(child.view(np.int64))], names=["id", "tree", "node"])

    return run


def _join(label: np.ndarray, i: int, found: np.ndarray) -> None:
    """One group of the groups of place i and of the places found; a group is named by its first place."""
    if len(found):
        groups = np.unique(np.append(label[found], label[i]))
        label[np.isin(label, groups)] = groups[0]


def _alike(least: int):
    """Per node: (a, b) for each document that has an earlier look-alike, b the first of those it reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "node"):
            ids = table.column("id").to_numpy()
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            sizes = np.diff(bounds)
            pairs = bounds[:-1][sizes == 2]
            hit = pairs[(sketch[pairs] == sketch[pairs + 1]).sum(axis=1) >= least]
            a, b = [ids[hit + 1]], [ids[hit]]
            for s, e in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist()):
                label, own = np.arange(e - s), sketch[s:e]
                for i in range(e - s - 1):
                    others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])  # look-alikes of look-alikes need no comparison
                    if len(others):
                        _join(label, i, others[(own[others] == own[i]).sum(axis=1) >= least])
                moved = np.flatnonzero(label != np.arange(e - s))
                a.append(ids[s + moved])
                b.append(ids[s + label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


class Block:
    """Sets of one task. label holds a place of each place's group of documents that links join."""

    def __init__(self, table: pa.Table, share: tuple[int, int], least: int):
        raw = table.column("shingles").to_pylist()
        self.lengths = np.array([len(x) // 8 for x in raw], np.int64)
        self.ends = np.concatenate(([0], np.cumsum(self.lengths)))
        self.codes = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)[1].astype(np.int32)
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        _, first, which = np.unique(table.column("label").to_numpy(), return_index=True, return_inverse=True)
        self.label = first[which]
        self.flag = np.zeros(int(self.codes.max()) + 1 if len(self.codes) else 1, np.int32)
        (self.part, self.whole), self.least = share, least

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the other places that link with place i and are not joined with it yet."""
        n, sizes = self.lengths[i], self.lengths[others]
        others = others[(self.label[others] != self.label[i]) & (self.whole * np.minimum(n, sizes) >= self.part * np.maximum(n, sizes))]
        others = others[(self.sketch[others] == self.sketch[i]).sum(axis=1) >= self.least]
        if not len(others):
            return others
        mine = self.codes[self.ends[i] : self.ends[i + 1]]
        sizes = self.lengths[others]
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(self.ends[others] - starts, sizes) + np.arange(int(sizes.sum()))
        self.flag[mine] = 1
        both = np.add.reduceat(self.flag[self.codes[at]], starts)
        self.flag[mine] = 0
        return others[self.whole * both >= self.part * (n + sizes - both)]

    def compare(self, places: np.ndarray, against: np.ndarray | None = None) -> None:
        """All pairs within the places, or of the places with others."""
        for k, i in enumerate(places.tolist()):
            _join(self.label, i, self.linked(i, places[k + 1 :] if against is None else against))


def _confirm(share: tuple[int, int], least: int):
    """Per cell: (a, b, blocks) for each label that links join with another one of the cell, b that of the first row. Sides 0 and 1 are compared with each other, one side within itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "cell"):
            label, side, blocks = (table.column(c).to_numpy() for c in ("label", "side", "blocks"))
            out = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s < 2:
                    continue
                block = Block(table.slice(s, e - s), share, least)
                here, there = np.flatnonzero(side[s:e] == 0), np.flatnonzero(side[s:e] == 1)
                block.compare(here, there if len(there) else None)
                own = label[s:e]
                _, at = np.unique(own, return_index=True)  # once each
                at = at[own[at] != own[block.label[at]]]
                out.append((own[at], own[block.label[at]], blocks[s + at]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b", "blocks"])

    return run


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """texts (id, cluster, blocks, text) with h1 and sorted hashes of the shingles instead of the text. Repeated rows come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in portions(batch.column(3)):
                made = shingle_sets(part, size)
                h1 = np.array([mixed(x).sum(dtype=np.uint64) for x in made], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, len(part)) for k in range(3)), pa.array(h1), pa.array([x.tobytes() for x in made], pa.binary())], names=["id", "cluster", "blocks", "h1", "shingles"])
                start += len(part)

    made = texts.mapInArrow(run, "id long, cluster long, blocks long, h1 long, shingles binary")
    return made.groupBy("id", "h1").agg(*(F.first(c).alias(c) for c in ("cluster", "blocks", "shingles")))


def prefixes(n: Column, share: tuple[int, int]) -> tuple[Column, Column]:
    """Of a set's n shingles, rarest first: how many are searched with, and how many are found by.

    Two sets that link, the smaller one of m shingles, share at least part / whole of n, and 2 part / (part + whole) of m. So one of the
    smaller set's first m - ceil(2 part m / (part + whole)) + 1 shingles is among the larger one's first n - ceil(part n / whole) + 1.
    """
    part, whole = share
    up = lambda x, by: F.floor((x + by - 1) / by)
    return n - up(part * n, whole) + 1, n - up(2 * part * n, part + whole) + 1


def _shared(rows: DataFrame, share: tuple[int, int], block_bytes: int, block_rows: int) -> DataFrame:
    """(id, cell, side) of sets (id, cluster, label, shingles) that may link and are not joined yet: those that share a rare shingle.

    Shingles are ordered by how many of the cluster's documents hold them. One that stands in all of them, as a template's does, is
    last in that order, and brings nobody together unless a document has next to nothing else. A shingle with more documents than a
    block deals them into blocks, each pair a cell of its own.
    """

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                held = np.frombuffer(batch.column(3)[k].as_py(), np.int64)
                same = [pa.array(np.full(len(held), batch.column(c)[k].as_py(), np.int64)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(held), pa.array(np.full(len(held), len(held), np.int64)), pa.array(np.full(len(held), 8 * len(held), np.int64))], names=["id", "cluster", "label", "shingle", "n", "bytes"])

    held = materialise(rows.select("id", "cluster", "label", "shingles").mapInArrow(exploded, "id long, cluster long, label long, shingle long, n long, bytes long"), "shingle-rows")
    often = held.groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("often"))
    search, found_by = prefixes(F.col("n"), share)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("often", "shingle"))
    first = held.join(often, ["cluster", "shingle"]).withColumn("rank", rank).where((F.col("rank") <= search) & (F.col("often") > 1)).withColumn("by", F.col("rank") <= found_by)
    first = materialise(first.select("id", "cluster", "label", "shingle", "bytes", "by"), "prefixes")
    discard(held)
    fit = lambda rows: F.ceil(F.greatest(F.sum(F.when(rows, F.col("bytes")).otherwise(0)) / block_bytes, F.sum(rows.cast("long")) / block_rows))
    nodes = first.groupBy("cluster", "shingle").agg(fit(F.col("by")).alias("by_blocks"), fit(F.lit(True)).alias("blocks"), (F.min("label") < F.max("label")).alias("several"))
    near = first.join(nodes.where("several AND by_blocks > 0"), ["cluster", "shingle"])
    one = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cell = F.xxhash64("cluster", "shingle", "x", "y").alias("cell")
    searched = near.where("by").withColumn("x", one("by_blocks")).withColumn("y", each("blocks")).select("id", cell, F.lit(0).alias("side"))
    others = near.withColumn("x", each("by_blocks")).withColumn("y", one("blocks")).select("id", cell, F.lit(1).alias("side"))
    return searched.unionAll(others)


def _links(sets: DataFrame, share: tuple[int, int], least: int, block_bytes: int, block_rows: int) -> DataFrame:
    """(id, component) of ids that links join with a smaller one, for sets (id, cluster, blocks, sketch, shingles); a cluster is the smallest id in it."""
    every = F.when(F.col("id") == F.col("cluster"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks"))))
    cells = sets.withColumn("of", F.explode(every)).select(F.xxhash64("cluster", "of").alias("cell"), F.lit(0).alias("side"), "id", F.col("id").alias("label"), "blocks", "sketch", "shingles")
    check = lambda cells: cells.repartition("cell").sortWithinPartitions("cell", "side", "id").mapInArrow(_confirm(share, least), "a long, b long, blocks long")
    found = materialise(check(cells), "links")
    # A cluster of one block has been compared as a whole, and its groups are named by their smallest ids.
    joined = found.where("blocks = 1").selectExpr("a id", "b component")
    wide = sets.where("blocks > 1")
    if wide.isEmpty():
        return joined
    labels = components(found.where("blocks > 1").select("a", "b"))
    rows = wide.join(labels, "id", "left").select("id", "cluster", F.coalesce("component", "id").alias("label"), "blocks", "sketch", "shingles")
    rows = materialise(rows, "labelled")
    ends = rows.select("id", "label").distinct()
    parted = materialise(rows.groupBy("cluster").agg((F.min("label") < F.max("label")).alias("several")).where("several"), "parted")
    if not parted.isEmpty():
        apart = rows.join(parted, "cluster", "left_semi")
        open_ = _shared(apart, share, block_bytes, block_rows)
        late = components(check(open_.join(rows.select("id", "label", "blocks", "sketch", "shingles"), "id")).select("a", "b"))
        ends = ends.join(late.selectExpr("id label", "component"), "label", "left").select("id", F.coalesce("component", "label").alias("label"))
    return joined.unionAll(ends.where("id <> label").selectExpr("id", "label component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, share: tuple[int, int] = (80, 100), trees: int | None = None, node_limit: int = 2048, block_bytes: int = 8 << 20, steps: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row.

    Documents link if share[1] * |A & B| >= share[0] * |A | B|. component_id is the smallest id that links reach; kept says
    whether it is the document's own.
    """
    part, whole = share
    trees = trees or trees_for(part / whole, steps)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = materialise(features(texts, shingle, trees * steps), "shingles")

    real = found.where("n > 0 AND id IS NOT NULL")
    # Written first: a join with the aggregate itself could not be dealt anew where one class has a great share of all rows.
    reps = real.groupBy("h1", "h2", "n").agg(F.min(F.struct("id", "tokens", "sketch")).alias("first"))
    reps = materialise(reps.select("first.*", "h1", "h2", "n"), "representatives")
    classes = reps.select("h1", "h2", "n", F.col("id").alias("rep"))
    member = found.select("id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left").select("id", "n", F.when(F.expr("n > 0"), F.col("rep")).otherwise(F.col("id")).alias("rep"))
    member = materialise(member, "classes")
    discard(found)

    rows, small, used = reps.select("id", "tokens").mapInArrow(_roots(trees, steps), "id long, tree int, node long"), None, [reps]
    crowd = None
    for step in range(1, steps + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = materialise(rows.join(sizes, "node"), "nodes")
        used.append(sized)
        done = sized.where(F.col("size") <= node_limit).select("id", "node")
        small = done if small is None else small.unionAll(done)
        large = sized.where(F.col("size") > node_limit)
        if large.isEmpty():
            break
        if step < steps:
            rows = large.select("id", "tree", "node").join(reps.select("id", "tokens"), "id").select("id", "tree", "node", "tokens").mapInArrow(_branch(trees, steps, step), "id long, tree int, node long")
    else:  # what the tokens do not divide
        firsts = large.groupBy("node").agg(F.min("id").alias("b"))
        crowd = large.join(firsts, "node").select(F.col("id").alias("a"), "b")

    # 4.5 standard deviations of an estimate from SKETCH values at the threshold itself.
    s = part / whole
    least = int(np.ceil(SKETCH * (s - 4.5 * np.sqrt(s * (1 - s) / SKETCH))))
    sketched = small.join(reps.select("id", "sketch"), "id").select("id", "node", "sketch")
    look = sketched.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_alike(least), "a long, b long")
    clusters = materialise(components(look if crowd is None else look.unionAll(crowd)), "clusters")

    sized = clusters.select("id", F.col("component").alias("cluster")).join(reps.select("id", "n"), "id")
    blocks = sized.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") * 8 / block_bytes, F.count(F.lit(1)) / node_limit)).alias("blocks"))
    # A first look joins what is close together; blocks for that need not be large.
    blocks = blocks.withColumn("blocks", F.when(F.col("blocks") > 1, F.col("blocks") * 4).otherwise(F.col("blocks")))
    near = materialise(clusters.select("id", F.col("component").alias("cluster")).join(blocks, "cluster"), "clustered")
    sets = _sets(texts.join(near, "id").select("id", "cluster", "blocks", "text"), shingle)
    sets = materialise(sets.join(reps.select("id", "h1", "sketch"), ["id", "h1"]), "sets")
    linked = materialise(_links(sets, share, least, block_bytes, node_limit), "linked")
    discard(sets, near, clusters, *used)

    out = member.join(linked.selectExpr("id rep", "component"), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=3, share=(85, 100))
