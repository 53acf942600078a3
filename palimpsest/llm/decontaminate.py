"""Benchmark decontamination by greedy string tiling.

Texts become words: runs of letters and digits of any script, in lower case. A document and an item are tiled if runs of
`tile` words that they share could cover enough of the item: no pair that tiles can cover is left out. Within such a pair the
longest runs that both still have unmarked are marked as tiles,
longest first, ties by place, until none of `tile` words is left; runs are found and compared by running Karp-Rabin hashes.
The item is in the document if tiles cover at least `coverage` of its words, in whatever order they stand.

The benchmark is taken in blocks of at most `block_bytes`; each block goes to the executors whole and meets every document
once, so neither side is shuffled and what is broadcast has a fixed bound, however large the benchmark.

Defined results: null or empty texts and items hold nothing; an item shorter than a tile is its own tile; rows without item_id are
left out; repeated documents are judged alike; repeated items give repeated pairs only once; empty tables give no rows; other
columns are never read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.words import Words, portions

#: Bits of the table that sorts out runs of words that no item holds.
_FILTER_BITS = 22
#: Places, of items or common to an item and a text, that are looked at at once.
_PLACES = 1 << 20


class Items:
    """One block of the benchmark: words of each item, and its runs of `tile` words as a sorted table.

    Tiles that cover c words of an item hold at least c / tile of its runs. So the item has one of its runs in common with a
    document even if the ceil(c / tile) - 1 runs that most items hold are left out: the others are its seeds.
    """

    def __init__(self, rows: list[tuple[int, str]], tile: int, coverage: float):
        rows = sorted({(i, t or "") for i, t in rows if i is not None})
        self.names = [i for i, _ in rows]
        words = Words(pa.array([t.lower() for _, t in rows], pa.string()), alphanumeric=True)
        self.words, self.tile, self.coverage = words, tile, coverage
        self.hashes = [words.hash[s:e] for s, e in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
        self.counts = counts = words.counts()
        full = words.places(tile)
        short = np.flatnonzero((counts > 0) & (counts < tile))
        at = np.concatenate((full, words.first[short]))
        length = np.concatenate((np.full(len(full), tile), counts[short])).astype(np.int64)
        order = np.argsort(at)
        self.at, self.length = at[order], length[order]
        owner = words.text_of(self.at)
        self.bounds = np.searchsorted(owner, np.arange(len(rows) + 1))
        self.keys, self.rank = np.unique(words.runs(self.at, self.length), return_inverse=True)
        self.lengths = np.unique(length)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        # Seeds: all but the most common runs of each item.
        often = np.bincount(self.rank, minlength=len(self.keys))[self.rank]
        order = np.lexsort((-often, owner))
        place = np.arange(len(order)) - self.bounds[owner[order]]
        spare = np.maximum(np.ceil((coverage * counts - 1e-6) / tile).astype(np.int64) - 1, 0)
        seeds = order[place >= spare[owner[order]]]
        seeds = seeds[np.argsort(self.rank[seeds], kind="stable")]
        self.seed_owner = owner[seeds]
        self.seed_bounds = np.searchsorted(self.rank[seeds], np.arange(len(self.keys) + 1))

    def candidates(self, words: Words) -> Iterator[tuple[int, int]]:
        """Documents of a batch and the items of which shared runs cover enough, in order."""
        if not len(self.keys):
            return
        shared = []
        for length in self.lengths.tolist():
            at = words.places(length)
            runs = words.runs(at, length)
            near = np.flatnonzero(self.filter[(runs >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            runs, at = runs[near], at[near]
            rank = np.minimum(np.searchsorted(self.keys, runs), len(self.keys) - 1)
            hit = self.keys[rank] == runs
            shared.append(words.text_of(at[hit]) * len(self.keys) + rank[hit])
        shared = np.unique(np.concatenate(shared))
        document, rank = np.divmod(shared, len(self.keys))
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], document, [-1]))))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            owners = np.unique(np.concatenate([self.seed_owner[self.seed_bounds[r] : self.seed_bounds[r + 1]] for r in rank[s:e].tolist()]))
            sizes = self.bounds[owners + 1] - self.bounds[owners]
            parts = np.cumsum(sizes) // _PLACES
            for part in np.unique(parts).tolist():
                yield from ((int(document[s]), x) for x in self._covered(owners[parts == part], rank[s:e]))

    def _covered(self, owners: np.ndarray, held: np.ndarray) -> list[int]:
        """Those of the items of which the runs that a document holds cover enough."""
        sizes = self.bounds[owners + 1] - self.bounds[owners]
        which = np.repeat(np.arange(len(owners)), sizes)
        places = np.repeat(self.bounds[owners] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        near = held[np.minimum(np.searchsorted(held, self.rank[places]), len(held) - 1)] == self.rank[places]
        which, places = which[near], places[near]
        at, cover = self.at[places], self.length[places].copy()
        same = which[1:] == which[:-1]
        cover[:-1][same] = np.minimum(cover[:-1], np.diff(at))[same]
        total = np.bincount(which, cover, len(owners))
        return owners[total >= self.coverage * self.counts[owners]].tolist()


def _matches(item: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in item, place in text, length) of each longest common run of at least `least` words.

    Places that share `least` words are joined along diagonals, _PLACES of them at a time; only whole runs are held.
    """
    base = np.uint64(0x9E3779B97F4A7C15)

    def rolling(x: np.ndarray) -> np.ndarray:
        h = np.zeros(max(0, len(x) - least + 1), np.uint64)
        for k in range(least):
            h = h * base + x[k : k + len(h)]
        return h

    in_item = rolling(item)
    order = np.argsort(in_item, kind="stable")
    keys = in_item[order]
    runs: list[tuple[np.ndarray, ...]] = []

    def join(j: np.ndarray, low: np.ndarray, spans: np.ndarray) -> None:
        i = order[np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))]
        j = np.repeat(j, spans)
        along = np.lexsort((j, j - i))
        i, j = i[along], j[along]
        new = np.ones(len(i), bool)
        new[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (j[1:] != j[:-1] + 1)
        starts = np.flatnonzero(new)
        runs.append((i[starts], j[starts], np.diff(np.append(starts, len(i)))))

    for s in range(0, len(text), _PLACES // 4):
        near = rolling(text[s : s + _PLACES // 4 + least - 1])
        low, high = np.searchsorted(keys, near, "left"), np.searchsorted(keys, near, "right")
        hits = np.flatnonzero(high > low)
        spans = (high - low)[hits]
        part = np.cumsum(spans) // _PLACES
        for k in np.unique(part).tolist():
            mine = part == k
            join(s + hits[mine], low[hits[mine]], spans[mine])
    if not runs:
        return (np.zeros(0, np.int64),) * 3
    i, j, n = (np.concatenate(x) for x in zip(*runs, strict=True))
    along = np.lexsort((j, j - i))  # runs that were cut between two portions
    i, j, n = i[along], j[along], n[along]
    new = np.ones(len(i), bool)
    new[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (j[1:] != j[:-1] + n[:-1])
    starts = np.flatnonzero(new)
    return i[starts], j[starts], np.add.reduceat(n, starts) + least - 1


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (place in item, place in text, length) of each tile."""
    least = max(1, min(least, len(item)))
    a, b, n = _matches(item, text, least)
    order = np.lexsort((b, a, -n))
    whole = zip((-n[order]).tolist(), a[order].tolist(), b[order].tolist())
    ahead = next(whole, None)
    parts: list[tuple[int, int, int]] = []  # what tiles left of longer runs
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    left, out = len(item), []
    while (ahead or parts) and left >= least:
        if ahead and (not parts or ahead < parts[0]):
            n, a, b = ahead
            ahead = next(whole, None)
        else:
            n, a, b = heapq.heappop(parts)
        n = -n
        free = free_item[a : a + n] & free_text[b : b + n]
        if free.all():
            out.append((a, b, n))
            free_item[a : a + n] = free_text[b : b + n] = False
            left -= n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= least:
                heapq.heappush(parts, (s - e, a + s, b + s))
    return out


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").where("item_id IS NOT NULL").distinct().orderBy("item_id", "text").toLocalIterator():
        n = len((row.text or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, tile: int = 3, coverage: float = 0.8, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item_words, n_matched, n_tiles, coverage) of each document and item that it holds."""
    schema = "doc_id long, item_id long, n_item_words long, n_matched long, n_tiles long, coverage double"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for rows in _blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], rows: list = rows) -> Iterator[pa.RecordBatch]:
            items = Items(rows, tile, coverage)
            for batch in batches:
                found, first = [], 0
                for part in portions(batch.column(1)):
                    words = Words(pa.array([(t or "").lower() for t in part.to_pylist()], pa.string()), alphanumeric=True)
                    for doc, owner in items.candidates(words):
                        item, text = items.hashes[owner], words.hash[words.first[doc] : words.first[doc + 1]]
                        laid = tiles(item, text, tile)
                        n = sum(x[2] for x in laid)
                        if n >= coverage * len(item):
                            found.append((batch.column(0)[first + doc].as_py(), items.names[owner], len(item), n, len(laid), n / len(item)))
                    first += len(part)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (*[pa.int64()] * 5, pa.float64()), strict=True)], names=["doc_id", "item_id", "n_item_words", "n_matched", "n_tiles", "coverage"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
