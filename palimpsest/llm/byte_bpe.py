"""Byte-level BPE by sentencepiece: a model serialised from a rank file, encoding and decoding.

The rank file (base64 token, space, rank per line) becomes a sentencepiece ModelProto of type BPE: each token's bytes are
mapped to printable characters, its score is its negative rank, the normaliser is the identity. A pair of symbols is then
merged in the order of the ranks, as byte-level BPE does. Texts are split by the vocabulary's own pattern first and each
match is encoded by itself.

No match of the pattern crosses from other characters into white space, so ids of such units are kept in a bounded table.

Defined results: a null or empty text has no ids; strings of special tokens are ordinary text; each row is encoded by itself,
repeated rows alike; other columns stay; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.unit_table import TextEncoder, splitter

#: Encoded matches that a process keeps in each of two generations.
TABLE = 150_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else from U+0100 on in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    kept = set(own)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of a protobuf message: varint, 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised ModelProto whose piece ids are the ranks; one more id, after them, is the unknown piece."""
    chars = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    pieces = [
        _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, normal))
        for rank, token in enumerate(tokens)
    ]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens))
    trainer += b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))  # no begin, end or padding piece: -1
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, identity)


class ByteBpe:
    """Encoder and decoder of one process."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.chars = dict(enumerate(byte_characters()))
        encoder = TextEncoder(splitter(pattern), self._encode_parts, entries=TABLE)
        self.encode, self.encode_many = encoder.encode, encoder.encode_many

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of each match of the pattern, as little-endian unsigned 32-bit integers."""
        mapped = [part.encode().decode("latin-1").translate(self.chars) for part in parts]
        return [np.array(ids, dtype="<u4").tobytes() for ids in self.processor.encode(mapped, num_threads=1)]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


_bpes: dict[tuple[str, str], ByteBpe] = {}


def bpe_of(path: str, pattern: str) -> ByteBpe:
    if (path, pattern) not in _bpes:
        _bpes[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _bpes[path, pattern]


def _mapped(docs: DataFrame, column: str, name: str, made) -> DataFrame:
    """docs with one more binary column, what `made` yields for a column of a batch."""
    if column == name:
        raise ValueError("the result needs a name of its own")
    keep = [f for f in docs.schema.fields if f.name != name]
    names = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in keep), f"`{name}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = batch.schema.get_field_index
            more = pa.array(list(made(batch.column(get(column)))), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(get(n)) for n in names), more], names=[*names, name])

    return docs.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, text_col: str = "text", out_col: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """docs with the ids of each text, as little-endian unsigned 32-bit integers (binary; empty for a null text)."""
    path, pattern = vocabulary or default_vocabulary()
    return _mapped(docs, text_col, out_col, lambda texts: (ids.tobytes() for ids in bpe_of(path, pattern).encode_many(texts)))


def decode_ids(docs: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """docs with the bytes that the ids stand for (empty for null). An id outside the vocabulary is an error."""
    path, pattern = vocabulary or default_vocabulary()
    return _mapped(docs, ids_col, out_col, lambda ids: (bpe_of(path, pattern).decode(x.as_py() or b"") for x in ids))


def encode_digests(docs: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of documents: encoded, decoded from the ids, digested, in one pass."""
    path, pattern = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_of(path, pattern)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for found in bpe.encode_many(batch.column(1)):
                ids = found.tobytes()
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                decoded_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
