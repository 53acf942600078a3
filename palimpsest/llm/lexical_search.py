"""Ranked lexical search over posting lists cut into blocks of variable length.

Index: tasks turn their documents into shards of about `shard_bytes` of text and at most `shard_docs` documents. One table holds a
row for each shard (no term; ids and lengths of its documents by ascending id) and one for each term of a shard: the documents that
hold it, with the number of occurrences. Rows are small, so that no reader or writer of the table holds several shards at once.

Search: after counts over all shards, the rows of wanted terms are dealt by shard, and a task takes up one shard after another. The
shard's lists get their impacts and are cut into blocks. Dynamic
programming chooses the boundaries so that the sum over blocks of (largest impact - own impact) and a price for each block is
least; boundaries stand between cells of `grain` postings, and a block has at most `reach` cells. For an item, the boundaries of
its terms' blocks divide the shard's documents into stretches, and the weighted block maxima add up to a bound for each. Stretches
whose bound is below the item's 20th best score so far are skipped with their blocks, the others are scored, best first, in
rounds. A task goes through its shards one after another and takes its thresholds along. Nothing is approximate: a bound equal to
the threshold is scored too, since ties go by id.

Items come in blocks of at most `block_bytes` of terms, and each block takes one scan of the index for counts and one for lists. What the driver and all tasks
hold of a block are its terms, their weights and the items' lists of them.

Defined results: null and empty texts have no terms, and count nowhere; each row of documents is a document of its own, and one
without id comes last among equals, as null; rows of items that share an id are one item with the terms of all its different
texts; items without terms, an empty table and a table without terms give no rows; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import NO_ID, materialise, partitions, whole_groups
from palimpsest.llm.words import portions

#: What a term is made of, as Spark's functions and as bytes of UTF-8: ASCII letters and digits, and all beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_INSIDE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER_AZ, _LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROWS = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary())])
_ROWS_DDL = "shard long, n_docs long, n_terms long, term string, df long, docs binary, counts binary"
#: Bytes of text, and lists, that are worked on at once.
_CHUNK, _LISTS = 2 << 20, 4096
#: Bytes that a writer of the index gathers, and shards that a task of the search goes through, at most on average.
_GROUP_BYTES, _SHARDS = 32 << 20, 4


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of the texts and where each begins, with the end."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), offsets - offsets[0]


def _chunks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about _CHUNK bytes that end where no term goes on."""
    low = 0
    while low < len(data):
        high = min(low + _CHUNK, len(data))
        while high < len(data) and _INSIDE[data[high]]:
            gaps = np.flatnonzero(~_INSIDE.take(data[high : high + _CHUNK]))
            high = high + int(gaps[0]) if len(gaps) else min(high + _CHUNK, len(data))
        yield low, high
        low = high


def term_counts(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(terms, number of the term, number of the text, occurrences) of texts, a portion at a time. A pair may come in several portions."""
    data, offsets = _bytes_of(texts)
    for low, high in _chunks(data):
        part = data[low:high]
        inside = _INSIDE.take(part)
        before = np.zeros(len(part) + 1, bool)
        before[1:] = inside
        bounds = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, high, "left")] - low
        before[bounds] = False  # a text begins here
        start = np.flatnonzero(inside & ~before[:-1])
        if not len(start):
            continue
        kept = _LOWER.take(part[inside])
        at = np.append(np.searchsorted(np.flatnonzero(inside), start), len(kept)).astype(np.int32)
        tokens = pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(kept)).dictionary_encode()
        owner = np.searchsorted(offsets, start + low, "right") - 1
        first = int(owner[0])
        pairs, often = np.unique(tokens.indices.to_numpy().astype(np.int64) * (int(owner[-1]) - first + 1) + owner - first, return_counts=True)
        term, doc = np.divmod(pairs, int(owner[-1]) - first + 1)
        yield tokens.dictionary, term, doc + first, often


class _Shard:
    """Documents of a shard in the making."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = self.bytes = 0

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        for terms, term, doc, often in term_counts(texts):
            self.parts.append((terms, term, doc + self.n, often))
        self.ids.append(ids)
        self.n += len(ids)
        self.bytes += pc.sum(pc.binary_length(texts)).as_py() or 0

    def rows(self, number: int) -> Iterator[pa.RecordBatch]:
        """The shard's own row, then those of its terms."""
        if not self.parts:
            return
        made = pa.chunked_array([p[0] for p in self.parts]).combine_chunks().dictionary_encode()
        shift = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        term = made.indices.to_numpy()[np.concatenate([p[1] + s for p, s in zip(self.parts, shift)])]
        doc, often = (np.concatenate([p[i] for p in self.parts]) for i in (2, 3))
        self.parts = []
        sizes = np.bincount(doc, often, self.n).astype(np.int64)
        ids = np.concatenate(self.ids)
        order = np.argsort(ids, kind="stable")
        order = order[sizes[order] > 0]
        place = np.zeros(self.n, np.int64)
        place[order] = np.arange(len(order))
        pairs, which = np.unique(term.astype(np.int64) * len(order) + place[doc], return_inverse=True)
        term, doc = np.divmod(pairs, len(order))
        often = np.bincount(which, often)
        starts = np.searchsorted(term, np.arange(len(made.dictionary) + 1))
        own = [number, len(order), int(sizes.sum()), None, None, ids[order].astype("<i8").tobytes(), sizes[order].astype("<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(own, _ROWS)], schema=_ROWS)
        doc, often = doc.astype("<i4"), often.astype("<i4")
        for s in range(0, len(starts) - 1, _LISTS):
            ends = starts[s : s + _LISTS + 1]
            at = pa.py_buffer(((ends - ends[0]) * 4).astype(np.int32))
            lists = [pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, at, pa.py_buffer(x[ends[0] : ends[-1]])]) for x in (doc, often)]
            none = pa.nulls(len(ends) - 1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends) - 1, number)), none, none, made.dictionary[s : s + _LISTS], pa.array(np.diff(ends)), *lists], schema=_ROWS)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 16 << 20, shard_docs: int = 1 << 16) -> DataFrame:
    """Shards of all documents, as a written table of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            first = 0
            for part in portions(batch.column(1)):
                for s in range(0, len(part), shard_docs):
                    few = part[s : s + shard_docs]
                    if shard.n + len(few) > shard_docs or shard.bytes >= shard_bytes:
                        yield from shard.rows(number)
                        shard, number = _Shard(), number + 1
                    shard.add(ids[first : first + len(few)], few)
                    first += len(few)
        yield from shard.rows(number)

    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    return materialise(source.mapInArrow(run, _ROWS_DDL), "postings", options={"parquet.block.size": _GROUP_BYTES})


def cut(lengths: np.ndarray, impacts: np.ndarray, grain: int = 8, reach: int = 32, price: float = 4.0) -> np.ndarray:
    """Where blocks begin in lists that stand one after another, each of at least one posting.

    Of all ways to cut a list between cells of `grain` postings, into blocks of up to `reach` cells, the one of least error: over
    blocks, largest impact times postings minus the sum of impacts, and `price` times the list's largest impact a block.
    """
    ends = np.cumsum(lengths)
    begins = ends - lengths
    cells = -(-lengths // grain)
    first = np.concatenate(([0], np.cumsum(cells)))
    owner = np.repeat(np.arange(len(lengths)), cells)
    at = begins[owner] + (np.arange(first[-1]) - first[owner]) * grain
    top = np.maximum.reduceat(impacts, at).astype(np.float64)
    total = np.add.reduceat(impacts, at).astype(np.float64)
    count = np.diff(np.append(at, len(impacts))).astype(np.float64)
    fee = price * np.maximum.reduceat(top, first[:-1])
    chosen = np.ones(first[-1], np.int64)
    by_length = np.argsort(-cells, kind="stable")
    for s in range(0, len(by_length), _LISTS):
        own = by_length[s : s + _LISTS]
        n = cells[own]
        if n[0] > 1:
            _choose(first[own], n, top, total, count, fee[own], reach, chosen)
    opens = np.zeros(first[-1] + 1, bool)
    left = cells.copy()  # cells of each list that are not in a block yet, from the end
    while (going := np.flatnonzero(left > 0)).size:
        left[going] -= chosen[first[going] + left[going] - 1]
        opens[first[going] + left[going]] = True
    return at[opens[:-1]]


def _choose(first: np.ndarray, cells: np.ndarray, top: np.ndarray, total: np.ndarray, count: np.ndarray, fee: np.ndarray, reach: int, chosen: np.ndarray) -> None:
    """Cells of the best last block of each list's beginnings. Lists come by falling length, so that those that go on are the first ones."""
    k = len(cells)
    peak, mass, size, before = np.zeros((k, reach)), np.zeros((k, reach)), np.zeros((k, reach)), np.full((k, reach), np.inf)
    best = np.zeros(k)
    for j in range(int(cells[0])):
        k = int(np.searchsorted(-cells, -j, "left"))
        here = first[:k] + j
        for held, new in ((mass, total[here]), (size, count[here])):
            held[:k, 1:] = held[:k, :-1]
            held[:k, 0] = 0
            held[:k] += new[:, None]
        peak[:k, 1:] = peak[:k, :-1]
        peak[:k, 0] = 0
        np.maximum(peak[:k], top[here][:, None], out=peak[:k])
        before[:k, 1:] = before[:k, :-1]
        before[:k, 0] = best[:k]
        cost = before[:k] + peak[:k] * size[:k] - mass[:k] + fee[:k, None]
        last = cost.argmin(axis=1)
        best[:k] = cost[np.arange(k), last]
        chosen[here] = last + 1


class Lists:
    """Blocks of the wanted terms' lists in one shard."""

    def __init__(self, shard: dict, wanted: pa.Array, weights: np.ndarray, n: int, total: int):
        where = pc.index_in(wanted, value_set=shard["terms"].values if isinstance(shard["terms"], pa.Scalar) else shard["terms"])
        found = np.flatnonzero(pc.is_valid(where).to_numpy(zero_copy_only=False) & (weights > 0))
        self.slot = np.full(len(wanted), -1, np.int64)
        self.slot[found] = np.arange(len(found))
        ids, sizes, starts = (np.frombuffer(shard[c], "<i8") for c in ("ids", "sizes", "starts"))
        at = where.take(pa.array(found)).to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = starts[at], starts[at + 1]
        lengths = high - low
        self.ids, self.n_docs = ids, len(ids)
        places = np.repeat(low - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        self.docs = np.frombuffer(shard["docs"], "<i4")[places].astype(np.int64)
        often = np.frombuffer(shard["counts"], "<i8")[places]
        longest = int(sizes.max(initial=1))
        sizes = sizes if 25 * longest * n < 1 << 62 else sizes.astype(object)
        m = (75 + (25 * sizes * n) // total).astype(np.int64)
        self.impacts = (1_000_000_000 * often) // (1000 * often + 12 * m[self.docs])
        self.weights = weights[found]
        self.keys = np.repeat(np.arange(len(found)), lengths) * self.n_docs + self.docs
        self.bounds = np.concatenate(([0], np.cumsum(lengths)))
        if not len(found):
            return
        opens = cut(lengths, self.impacts)
        self.top = np.maximum.reduceat(self.impacts, opens)
        self.first = self.docs[opens]
        self.last = self.docs[np.append(opens[1:], len(self.docs)) - 1]
        self.blocks = np.searchsorted(opens, self.bounds)
        self.highest = np.maximum.reduceat(self.impacts, self.bounds[:-1])

    def search(self, terms: np.ndarray, often: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """best (scores, ids), and this shard's documents that come before them or fill them up."""
        slots = self.slot[terms]
        have = slots >= 0
        slots, weights = slots[have], often[have] * self.weights[slots[have]]
        least = best[0][k - 1] if len(best[0]) >= k else 1
        if not len(slots) or int((weights * self.highest[slots]).sum()) < least:
            return best
        counts = self.blocks[slots + 1] - self.blocks[slots]
        own = np.repeat(self.blocks[slots] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        worth = np.repeat(weights, counts) * self.top[own]
        edges, place = np.unique(np.concatenate((self.first[own], self.last[own] + 1)), return_inverse=True)
        steps = np.zeros(len(edges), np.int64)
        np.add.at(steps, place, np.concatenate((worth, -worth)))
        bound = np.cumsum(steps)[:-1]
        order = np.argsort(-bound, kind="stable")
        done, width = 0, 16
        while done < len(order):
            least = best[0][k - 1] if len(best[0]) >= k else 1
            round_ = order[done : done + width]
            round_ = round_[bound[round_] >= least]
            if not len(round_):
                break
            best = _best(k, best, *self._scored(slots, weights, np.sort(round_), edges))
            done, width = done + width, width * 4
        return best

    def _scored(self, slots: np.ndarray, weights: np.ndarray, stretches: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of all documents in the stretches that hold a term."""
        base = slots[:, None] * self.n_docs
        low = np.searchsorted(self.keys, (base + edges[stretches]).ravel())
        high = np.searchsorted(self.keys, (base + edges[stretches + 1]).ravel())
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        part = np.repeat(np.repeat(weights, len(stretches)), n) * self.impacts[at]
        docs = self.docs[at]
        order = np.argsort(docs, kind="stable")
        docs = docs[order]
        opens = np.flatnonzero(np.concatenate((docs[:1] >= 0, docs[1:] != docs[:-1])))
        scores = np.add.reduceat(part[order], opens) if len(opens) else part[:0]
        held = scores > 0
        return scores[held], self.ids[docs[opens][held]]


def _best(k: int, best: tuple[np.ndarray, np.ndarray], scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = np.concatenate((best[0], scores)), np.concatenate((best[1], ids))
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _items(items: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list]:
    """Blocks of (item id, terms with their occurrences)."""
    lower = F.translate(F.col(text_col), _UPPER_AZ, _LOWER_AZ)
    terms = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col)).distinct().select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    rows = terms.groupBy("item_id", "term").count().groupBy("item_id").agg(F.collect_list(F.struct("term", "count")).alias("terms"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        n = sum(len(t["term"].encode()) for t in row.terms)
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row.item_id, [(t["term"], t["count"]) for t in row.terms]))
        size += n
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 16 << 20, block_bytes: int = 8 << 20, shard_docs: int = 1 << 16) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's k best documents."""
    spark, schema = docs.sparkSession, "item_id long, rank int, doc_id long, score long"
    rows = index(docs, id_col, text_col, shard_bytes, shard_docs)
    n, total, shards = rows.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("n_docs")).first()
    out = None
    for block in _items(items, item_col, item_text_col, block_bytes) if n else ():
        found = _search_block(rows, shards, block, k, n, total)
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def _shard_of(rows: pa.Table, wanted: pa.Array) -> dict:
    """A shard's own row, which comes first, and those of wanted terms, as Lists takes them."""
    docs, counts = (rows.column(c).slice(1).to_pylist() for c in ("docs", "counts"))
    starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in docs])))
    return {
        "ids": rows.column("docs")[0].as_py(), "sizes": rows.column("counts")[0].as_py(), "terms": wanted.take(rows.column("number").slice(1)).combine_chunks(),
        "starts": starts.astype("<i8").tobytes(), "docs": b"".join(docs), "counts": np.frombuffer(b"".join(counts), "<i4").astype("<i8").tobytes(),
    }


def _search_block(rows: DataFrame, shards: int, block: list, k: int, n: int, total: int) -> DataFrame:
    spark = rows.sparkSession
    wanted = pa.array(sorted({t for _, terms in block for t, _ in terms}), pa.string())
    told = lambda numbers: F.broadcast(spark.createDataFrame(pa.table({"term": wanted.take(pa.array(numbers)), "number": pa.array(numbers)}), "term string, number long"))
    df = np.zeros(len(wanted), np.int64)
    for row in rows.select("term", "df").join(told(np.arange(len(wanted))), "term").groupBy("number").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row.number] = row.df
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    number = {t: i for i, t in enumerate(wanted.to_pylist())}
    queries = [(item, np.array([number[t] for t, _ in terms]), np.array([c for _, c in terms], np.int64)) for item, terms in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for table, bounds in whole_groups(batches, "shard"):
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if e - s > 1:
                    lists = Lists(_shard_of(table.slice(s, e - s), wanted), wanted, weights, n, total)
                    best = [lists.search(terms, often, k, held) for (_, terms, often), held in zip(queries, best)]
        for (item, *_), (scores, ids) in zip(queries, best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int64()), pa.array(ids), pa.array(scores)], names=["item_id", "doc_id", "score"])

    columns = ("shard", "number", "docs", "counts")
    lists = rows.join(told(np.flatnonzero(weights > 0)), "term").select(*columns)
    lists = rows.where("term IS NULL").withColumn("number", F.lit(-1).cast("long")).select(*columns).unionAll(lists)
    # Few shards go by the session's number of partitions, which small ones are joined of; many have as many as they need.
    dealt = lists.repartition("shard") if shards <= _SHARDS * partitions(spark) else lists.repartition(-(-shards // _SHARDS), "shard")
    return dealt.sortWithinPartitions("shard", "number").mapInArrow(run, "item_id long, doc_id long, score long")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


OP13_SQL = r"""
WITH terms AS (
  SELECT doc_id, n, unnest(regexp_extract_all(LOWERED, '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM (SELECT row_number() OVER () AS n, doc_id, text FROM documents)
), postings AS (
  SELECT n, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), sizes AS (
  SELECT n, CAST(sum(tf) AS BIGINT) AS size FROM postings GROUP BY n
), totals AS (
  SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS total FROM sizes
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, docs
), wanted AS (
  SELECT item_id, term, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(LOWERED, '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
), scored AS (
  SELECT item_id, p.n, p.doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * docs) // total)))) AS BIGINT) AS score
  FROM wanted q JOIN postings p ON p.term = q.term JOIN weights x ON x.term = q.term JOIN sizes s ON s.n = p.n, totals GROUP BY ALL
)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0) WHERE r <= 20
""".replace("LOWERED", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
