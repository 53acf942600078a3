"""Quality classifier: a support vector machine on Naive Bayes features.

A text becomes indicators of n-grams: of its bytes, of its outline (runs of lower case, upper case, digits, spaces and marks)
and of which words repeat the word before. Indicators are scaled by the log-count ratio of the classes, rows to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent. Margins become scores by a logistic curve fitted
to out-of-fold margins.

Fitting takes a bounded sample of labelled ids (`max_labels`, those of the smallest hashes); scoring covers every whole
text. The model is a vector of a fixed size, so what executors get does not grow with the data.

Defined results: a null or empty text has no n-grams and gets the score of the empty text, like any other; without labels of
both classes the score is the share of label 1 (0.5 without any label); rows without doc_id are not held out; null labels
are left out; repeated rows are scored alike; an empty table gives no rows; further columns stay, but for those named like the
results, which give way; the query returns none of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.words import Words, portions

#: Buckets of the three kinds of n-grams: bytes, outline, repetition.
BYTE_BUCKETS, SHAPE_BUCKETS, SAME_BUCKETS = 1 << 16, 1 << 14, 64
FEATURES = BYTE_BUCKETS + SHAPE_BUCKETS + SAME_BUCKETS
SHAPE_ORDERS = (1, 2, 3, 4, 6)
#: Classes of bytes in an outline: every mark has its own, letters and digits share three.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3


#: Bytes, or words, of one text that are looked at at once.
SLICE = 1 << 20


class Indicators:
    """n-grams of a batch of texts; `of(i)` gives the features of text i. Long texts are gone through in slices."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        words = Words(texts)
        self.data, self.offsets = words.data, words.offsets
        same = np.zeros(len(words), np.int8)
        same[1:] = words.hash[1:] == words.hash[:-1]
        starts = words.first[:-1]
        same[starts[starts < len(words)]] = 0
        self.same, self.first = same, words.first
        self.flags = np.zeros(FEATURES, bool)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def mark(self, i: int) -> np.ndarray:
        """Flags of text i, in a buffer that the next call uses again."""
        flags = self.flags
        flags[:] = False
        end = int(self.offsets[i + 1])
        before = np.zeros(0, np.uint32)  # the outline's last symbols in earlier slices
        for low in range(int(self.offsets[i]), end, SLICE):
            data = self.data[low : min(low + SLICE + 2, end)]
            if len(data) > 2:
                wide = data.astype(np.uint32)
                code = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
                flags[(code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int32)] = True
            outline = np.concatenate((before, _CLASS[data[:SLICE]].astype(np.uint32)))
            keep = np.ones(len(outline), bool)
            keep[1:] = outline[1:] != outline[:-1]
            outline = outline[keep]
            for order in SHAPE_ORDERS:
                n = len(outline) - order + 1
                if n <= 0:
                    break
                code = np.full(n, order, np.uint32)
                for k in range(order):
                    code = code * np.uint32(0x01000193) ^ outline[k : k + n]
                flags[BYTE_BUCKETS + (code * np.uint32(2654435761) >> np.uint32(18)).astype(np.int32)] = True
            before = outline[-max(SHAPE_ORDERS) :]
        base = BYTE_BUCKETS + SHAPE_BUCKETS
        for low in range(int(self.first[i]), int(self.first[i + 1]), SLICE):
            same = self.same[low : min(low + SLICE + 3, int(self.first[i + 1]))]
            for order in (1, 2, 4):
                n = len(same) - order + 1
                if n <= 0:
                    break
                code = np.zeros(n, np.int32)
                for k in range(order):
                    code = code * 2 + same[k : k + n]
                flags[base + (1 << order) + code] = True
        return flags

    def of(self, i: int) -> np.ndarray:
        return np.flatnonzero(self.mark(i))


class Rows:
    """Features of labelled texts. Up to `budget` bytes of them stand unpacked; the others are unpacked each time they are looked at."""

    def __init__(self, found: list[bytes], budget: int = 128 << 20):
        self.held: list[bytes | np.ndarray] = []
        for data in found:
            row = unpacked(data)
            budget -= row.nbytes
            self.held.append(row if budget >= 0 else data)

    def __len__(self) -> int:
        return len(self.held)

    def __getitem__(self, i: int) -> np.ndarray:
        held = self.held[i]
        return unpacked(held) if isinstance(held, bytes) else held


def log_count_ratio(rows: Rows, own: np.ndarray, y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(FEATURES, smooth), np.full(FEATURES, smooth)
    for i in own:
        (p if y[i] > 0 else q)[rows[i]] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: Rows, own: np.ndarray, scale: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum cost_i max(0, 1 - y_i (w x_i + b)), over the dual, one alpha at a time; b is the weight of a feature 1.

    x_i holds the ratios `scale` of a row's features, of length 1; it is made anew for each step, and nothing but its norm is kept.
    """
    w, b = np.zeros(FEATURES), 0.0
    alpha, norm, square = np.zeros(len(own)), np.empty(len(own)), np.empty(len(own))
    for i, at in enumerate(own):
        value = scale[rows[at]]
        norm[i] = max(np.linalg.norm(value), 1e-6)
        value = value / norm[i]
        square[i] = value @ value + 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(own)):
            row = rows[own[i]]
            value = scale[row] / norm[i]
            sign = y[own[i]]
            gradient = sign * (w[row] @ value + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign
            if step:
                w[row] += step * value
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def fit_curve(margins: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton's method on smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


@dataclass
class Model:
    """scale: log-count ratios; weights already hold them once more (weights[i] = w[i] * scale[i])."""

    weights: np.ndarray
    square: np.ndarray
    bias: float
    curve: tuple[float, float]
    constant: float | None = None

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = []
        for part in portions(texts):
            seen = Indicators(part)
            for i in range(len(seen)):
                found = seen.of(i)
                out.append(self.weights[found].sum() / np.sqrt(max(self.square[found].sum(), 1e-12)) + self.bias)
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * np.array(out, np.float64) + b, -30, 30)))


def _fit_once(rows: Rows, own: np.ndarray, y: np.ndarray, cost: float) -> tuple[np.ndarray, np.ndarray, float]:
    scale = log_count_ratio(rows, own, y)
    share = (y[own] > 0).mean()
    weight = np.where(y[own] > 0, 0.5 / share, 0.5 / (1 - share)) * cost
    w, b = dual_coordinate_descent(rows, own, scale, y, weight)
    return (w * scale).astype(np.float32), (scale * scale).astype(np.float32), b


def fit_rows(rows: Rows, quality: np.ndarray, cost: float = 4.0, folds: int = 3) -> Model:
    y = np.where(quality > 0, 1.0, -1.0)
    empty = np.zeros(0, np.float32)
    if min((y > 0).sum(), (y < 0).sum()) < folds:
        return Model(empty, empty, 0.0, (1.0, 0.0), float((y > 0).mean()) if len(y) else 0.5)
    margins = np.empty(len(y))
    fold = np.empty(len(y), int)
    for sign in (-1, 1):
        mine = np.flatnonzero(y == sign)
        fold[mine] = np.arange(len(mine)) % folds
    for k in range(folds):
        w, square, b = _fit_once(rows, np.flatnonzero(fold != k), y, cost)
        for i in np.flatnonzero(fold == k):
            row = rows[i]
            margins[i] = w[row].sum() / np.sqrt(max(square[row].sum(), 1e-12)) + b
    w, square, b = _fit_once(rows, np.arange(len(y)), y, cost)
    return Model(w, square, b, fit_curve(margins, y))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def packed(found: np.ndarray) -> bytes:
    """Features as a list of 32-bit numbers or as a bit for each, whichever is shorter: a text of any length takes 10 KB at most."""
    if 4 * len(found) < FEATURES // 8:
        return b"L" + found.astype("<i4").tobytes()
    flags = np.zeros(FEATURES, bool)
    flags[found] = True
    return b"B" + np.packbits(flags).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i4", offset=1) if data[:1] == b"L" else np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), count=FEATURES)).astype(np.int32)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 6000) -> Model:
    """Learns from at most max_labels labelled ids that are not held out: those of the smallest hashes.

    Of rows that share an id the one of the smallest features counts, of several labels of an id each; the sample is the same
    whatever the order of rows. The driver gets at most max_labels times 10 KB, each row's features made where its text lies, and unpacks 128 MB of them at most.
    A table without usable labels gives a model that gives every text the share of good ones, or one half.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labels)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for part in portions(batch.column(2)):
                seen = Indicators(part)
                found += [packed(seen.of(i)) for i in range(len(seen))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "quality", "features"])

    # At most max_labels ids: small by that parameter.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    found = joined.mapInArrow(features, "doc_id long, quality int, features binary").groupBy("doc_id", "quality").agg(F.min("features").alias("features"))
    got = sorted((r.doc_id, r.quality, bytes(r.features)) for r in found.collect())
    return fit_rows(Rows([f for _, _, f in got]), np.array([q for _, q, _ in got]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1; higher: label 1 likelier) and predicted (1 if score >= threshold, else 0)."""
    keep = [f for f in docs.schema.fields if f.name not in ("score", "predicted")]
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in keep), "score double, predicted int"])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(batch.column(batch.schema.get_field_index("text")))
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
