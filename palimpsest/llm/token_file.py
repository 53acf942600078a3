"""Token-id files: concatenated ids, and document boundaries in Elias-Fano form.

A file holds a run of documents in ascending doc_id order:

    magic "PTF1" | u32 header length | header (JSON: counts, bytes of an id, sizes of the parts) | ids | ends | doc ids

`ends` (end offset of each document in ids) and `doc ids` are non-decreasing sequences in Elias-Fano form: about
2 + log2(universe / count) bits an entry, and a select structure that gives entry i without a table of 64-bit offsets.

Files are rows (file, part, seq, ..., data) of a Parquet table in the shared folder, since executors can write elsewhere
only through Spark; `export_files` puts them out as plain files.

Defined results: a null or empty text has only the end id; rows without doc_id come first; an empty table makes no files;
repeated rows are encoded each, and rows of one doc_id stand in the order of their texts' hashes; a special token's string in a
text becomes that token's id, as the tokenizers library has it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise, partitions
from palimpsest.llm.unit_table import WHITE, TextEncoder, splitter
from palimpsest.llm.words import portions

MAGIC = b"PTF1"
#: What the tokenizers library splits texts by before byte-level merges. Fixed value.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Matches that are encoded in one call; the library is slower with longer texts.
CHUNK = 200
_SPACED = re.compile(f"[{WHITE}]")
#: Every so many entries the select structure keeps the place of one.
SAMPLE = 256
#: So many blocks of entries are put out as one batch of rows.
BLOCKS = 32
#: A file is closed at this many ids; a longer document has a file of its own.
FILE_IDS = 4_000_000


class EliasFano:
    """A non-decreasing sequence of integers >= base."""

    def __init__(self, low_bits: int, count: int, base: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.low_bits, self.count, self.base, self.low, self.high, self.samples = low_bits, count, base, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        base = int(values[0])
        gaps = (values.view(np.uint64) - np.uint64(base & 2**64 - 1)).astype(np.uint64)
        low_bits = max(0, (int(gaps[-1]) // n).bit_length() - 1)
        high_values = (gaps >> np.uint64(low_bits)).astype(np.int64)
        places = high_values + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        if low_bits:
            low = (gaps[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :] & np.uint64(1)).astype(np.uint8).ravel()
        else:
            low = np.zeros(0, np.uint8)
        return cls(low_bits, n, base, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack("<BqQII", self.low_bits, self.base, self.count, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> EliasFano:
        low_bits, base, count, n_low, n_high = struct.unpack_from("<BqQII", data)
        at = struct.calcsize("<BqQII")
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        samples = np.frombuffer(data, np.uint32, -(-count // SAMPLE), at + n_low + n_high)
        return cls(low_bits, count, base, low, high, samples)

    def _low_of(self, i: int) -> int:
        bit = i * self.low_bits
        chunk = int.from_bytes(self.low[bit >> 3 : (bit + self.low_bits + 7) >> 3].tobytes(), "little")
        return chunk >> (bit & 7) & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """Entry i: from the nearest sample on, the i-th set bit of the high part, then the low bits."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place >> 3
        skip = bin(int(self.high[at]) & (1 << (place & 7)) - 1).count("1")
        left += skip
        while True:
            window = self.high[at : at + 64]
            ones = np.unpackbits(window, bitorder="little")
            total = int(ones.sum())
            if left < total:
                place = at * 8 + int(np.flatnonzero(ones)[left])
                break
            left -= total
            at += 64
        return (place - i << self.low_bits | self._low_of(i)) + self.base

    __getitem__ = select

    def select_block(self, k: int) -> np.ndarray:
        """The entries from the k-th sample up to the next one, read from that place on: nothing else is unpacked."""
        first, last = k * SAMPLE, min((k + 1) * SAMPLE, self.count)
        if not 0 <= first < self.count:
            raise IndexError(k)
        place = int(self.samples[k])
        stop = int(self.samples[k + 1]) if last < self.count else len(self.high) * 8
        at = place >> 3
        places = np.flatnonzero(np.unpackbits(self.high[at : (stop + 7) >> 3], bitorder="little")) + at * 8
        places = places[np.searchsorted(places, place) :][: last - first]
        out = (places - np.arange(first, last)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = first * self.low_bits
            bits = np.unpackbits(self.low[bit >> 3 : (last * self.low_bits + 7) >> 3], bitorder="little")[bit & 7 :][: len(out) * self.low_bits]
            out |= (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (out + np.uint64(self.base & 2**64 - 1)).view(np.int64)

    def blocks(self) -> Iterator[np.ndarray]:
        """The sequence in blocks of SAMPLE entries."""
        return (self.select_block(k) for k in range(-(-self.count // SAMPLE)))

    def values(self) -> np.ndarray:
        """The whole sequence."""
        if not self.count:
            return np.zeros(0, np.int64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        out = (places - np.arange(self.count)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.count * self.low_bits].reshape(self.count, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (out + np.uint64(self.base & 2**64 - 1)).view(np.int64)


def write_file(doc_ids: list[int | None], ids: list[np.ndarray], id_bytes: int) -> bytes:
    """One file. Documents without id must come first."""
    lengths = np.array([len(x) for x in ids], np.int64)
    without = sum(x is None for x in doc_ids)
    ends = EliasFano.encode(np.cumsum(lengths)).to_bytes()
    names = EliasFano.encode(np.array(doc_ids[without:], np.int64)).to_bytes()
    body = np.concatenate(ids).astype(f"<u{id_bytes}").tobytes()
    head = json.dumps({"docs": len(doc_ids), "without_id": without, "ids": int(lengths.sum()), "id_bytes": id_bytes, "ends": len(ends), "doc_ids": len(names)}).encode()
    return b"".join((MAGIC, struct.pack("<I", len(head)), head, body, ends, names))


class TokenFile:
    """Reads one file."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack_from("<I", data, 4)[0]
        self.head = json.loads(bytes(data[8 : 8 + size]))
        at = 8 + size
        self.ids = np.frombuffer(data, f"<u{self.head['id_bytes']}", self.head["ids"], at)
        at += self.head["ids"] * self.head["id_bytes"]
        self.ends = EliasFano.from_bytes(memoryview(data)[at : at + self.head["ends"]])
        self.doc_ids = EliasFano.from_bytes(memoryview(data)[at + self.head["ends"] :])

    def __len__(self) -> int:
        return self.head["docs"]

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return self.ids[start:end]


_encoders: dict[str, tuple] = {}


def json_encoder(path: str):
    """A function of an array of texts that yields the ids of each, and the bytes that an id needs in a file. Made once a process."""
    if path not in _encoders:
        _encoders[path] = _json_encoder(path)
    return _encoders[path]


def _json_encoder(path: str):
    from tokenizers import Tokenizer, pre_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    id_bytes = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
    told = json.loads(tokenizer.to_str())
    before = told["pre_tokenizer"] or {}
    plain = not told["normalizer"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in told["added_tokens"]):
        return lambda texts: (np.array(tokenizer.encode(t.as_py() or "", add_special_tokens=False).ids, dtype="<u4") for t in texts), id_bytes
    newline = tokenizer.encode("\n", add_special_tokens=False).ids[0]

    # Lines of one match each need no pattern, and, as they are all new, no cache.
    lines = Tokenizer.from_file(path)
    lines.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    lines.model._resize_cache(0)

    def cut(chunks: list[str]) -> Iterator[bytes]:
        """Ids of each line: a newline behind other characters becomes an id of its own."""
        for encoding in lines.encode_batch_fast(chunks, add_special_tokens=False):
            ids = np.array(encoding.ids, dtype="<u4")
            data, start = ids.tobytes(), 0
            for end in (np.flatnonzero(ids == newline) * 4).tolist():
                yield data[start:end]
                start = end + 4

    # What the pattern and the line ends cut never holds a whole added token: texts that do are cut at it first.
    added = {t["content"]: np.array([t["id"]], "<u4") for t in told["added_tokens"]}

    def encode_words(words: list[str]) -> list[bytes]:
        return [*cut([" " + "\n ".join(words[i : i + CHUNK]) + "\n" for i in range(0, len(words), CHUNK)])]

    def encode_parts(parts: list[str]) -> list[bytes]:
        single = [not _SPACED.search(p, p[0] == " ") and p != " " for p in parts]
        together = [x for x, p in zip(parts, single, strict=True) if p]
        joint = cut(["\n".join(together[i : i + CHUNK]) + "\n" for i in range(0, len(together), CHUNK)])
        alone = iter(tokenizer.encode_batch([x for x, p in zip(parts, single, strict=True) if not p], add_special_tokens=False))
        return [next(joint) if p else np.array(next(alone).ids, dtype="<u4").tobytes() for p in single]

    encoder = TextEncoder(splitter(BYTE_LEVEL), encode_parts, encode_words)
    return (around(encoder, added) if added else encoder.encode_many), id_bytes


def around(encoder: TextEncoder, added: dict[str, np.ndarray]):
    """encode_many of texts in which added tokens stand for themselves; the longest counts where several begin."""
    cut = re.compile("|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)))

    def encode_many(texts: pa.Array) -> Iterator[np.ndarray]:
        for part in portions(texts, 8 << 20):
            held = np.flatnonzero(pc.fill_null(pc.match_substring_regex(part, cut.pattern), False).to_numpy(zero_copy_only=False))
            split = {}
            for i in held.tolist():
                text = part[i].as_py()
                split[i] = [m[0] for m in cut.finditer(text)], cut.split(text)
            between = iter(encoder.encode_many(pa.array([x for _, pieces in split.values() for x in pieces], pa.string())))
            others = iter(encoder.encode_many(part.filter(pa.array(~np.isin(np.arange(len(part)), held)))))
            for i in range(len(part)):
                if i in split:
                    marks, pieces = split[i]
                    ids = [next(between)]
                    for mark in marks:
                        ids += [added[mark], next(between)]
                    yield np.concatenate(ids)
                else:
                    yield next(others)

    return encode_many


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_files(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 2, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Encodes docs in ascending id order; the table of files (part, seq, file, n_docs, n_ids, data), as written.

    It is written to `folder`, and stays there; without one it is a scratch table, which goes when the application ends.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, id_bytes = json_encoder(path)
        end = np.array([end_id], "<u4")
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            data = write_file(names, held, id_bytes)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": f"{part:06d}-{seq:06d}.ptf", "n_docs": len(names), "n_ids": size, "data": data}], schema=kept)

        kept = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.append(found, end)
                if names and size + len(ids) > file_ids:
                    yield close()
                    names, held, size, seq = [], [], 0, seq + 1
                names.append(name)
                held.append(ids.astype(f"<u{id_bytes}"))
                size += len(ids)
        if names:
            yield close()

    # Rows of one id, or of none, go by their text and at last by where they lie, so that no id makes a partition of its own.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(partitions(spark), "id", "hash", "place").sortWithinPartitions("id", "hash", "place").select("id", "text")
    return materialise(ordered.mapInArrow(run, "part int, seq int, file string, n_docs long, n_ids long, data binary"), "token-files", path=folder)


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document; start counts the ids of all documents before it."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = files.select("part", "seq", "n_ids").withColumn("base", before).drop("n_ids")  # one small row a file

    def together(rows: list) -> pa.RecordBatch:
        columns = [pa.concat_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in column]) for column in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for part, seq, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                file = TokenFile(data.as_buffer())
                names = chain(repeat(None, file.head["without_id"]), (x for block in file.doc_ids.blocks() for x in block.tolist()))
                before = 0
                for ends in file.ends.blocks():
                    starts = np.concatenate(([before], ends[:-1]))
                    before, n = int(ends[-1]), len(ends)
                    sums = [zlib.crc32(file.ids[s:e].astype("<u4")) for s, e in zip(starts.tolist(), ends.tolist())]
                    rows.append((np.full(n, part.as_py(), np.int32), np.full(n, seq.as_py(), np.int32), pa.array(islice(names, n), pa.int64()), starts, ends - starts, np.array(sums, np.int64)))
                    if len(rows) == BLOCKS:
                        yield together(rows)
                        rows = []
                if rows:
                    yield together(rows)
                    rows = []

    local = files.select("part", "seq", "data").mapInArrow(run, "part int, seq int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return local.join(bases, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def export_files(files: DataFrame, folder: str) -> list[str]:
    """Puts the files out one by one as plain files in a folder of the driver, and returns their paths."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    for row in files.select("file", "data").toLocalIterator():
        paths.append(os.path.join(folder, row.file))
        with open(paths[-1], "wb") as out:
            out.write(row.data)
    return paths


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_token_files(write_token_files(docs))
