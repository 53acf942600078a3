"""The restoration credential as text: base64 of JSON, or of a compact binary form that holds matched text only.

Binary form, little-endian: u32 size of all, u32 size of the text, the matched texts one after another, padding to 4, then
20 bytes an item: u32 id, u8 kind, 3 unused, u32 start, u32 end (both in that text), f32 score; up to 4 bytes of slack.
A credential holds original text: protect it like the text itself.
"""

from __future__ import annotations

import base64
import json
import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from palimpsest.functions.entities import ENTITIES
from palimpsest.operators.masking import ITEM, META

_RECORD = struct.Struct("<IB3xIIf")
_ITEMS = pa.list_(pa.struct([("id", pa.int64()), ("type_id", pa.int8()), ("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float32())]))
_META = pa.struct([("original", pa.string()), ("items", _ITEMS)])


def encode_json(meta: Column) -> Column:
    """Native: {"original", "items": [{"id", "type", "start", "end", "score"}]} in base64."""
    items = F.transform(meta["items"], lambda i: F.struct(i["id"].alias("id"), i["type_id"].cast("int").alias("type"), i["start"].alias("start"), i["end"].alias("end"), i["score"].alias("score")))
    body = F.to_json(F.struct(F.coalesce(meta["original"], F.lit("")).alias("original"), F.coalesce(items, F.array().cast("array<struct<id:bigint,type:int,start:int,end:int,score:float>>")).alias("items")))
    return F.translate(F.base64(F.encode(body, "UTF-8")), "\r\n", "")


def pack(items: list[dict]) -> bytes:
    """items: id, type_id, score and the text itself, as bytes."""
    if not all(1 <= i["type_id"] <= len(ENTITIES) and i["text"] for i in items):
        raise ValueError("an item is of no known kind or beyond the original")
    held = b"".join(i["text"] for i in items)
    total = 12 + len(held) + _RECORD.size * len(items)
    if total >= 1 << 32:
        raise ValueError("a credential is below 4 GiB")
    body = bytearray(struct.pack("<II", total, len(held)) + held)
    body += bytes(-len(body) % 4)
    at = 0
    for item in items:
        body += _RECORD.pack(item["id"], item["type_id"], at, at + len(item["text"]), item["score"])
        at += len(item["text"])
    return bytes(body.ljust(total, b"\0"))


def unpack(data: bytes) -> tuple[str, list[dict]]:
    fault = ValueError("not a binary credential")
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != len(data):
        raise fault
    size = struct.unpack_from("<I", data, 4)[0]
    at = 8 + size + (-size % 4)
    if 8 + size > len(data) or at > len(data) or (len(data) - at) % _RECORD.size > 4:
        raise fault
    original, items = data[8 : 8 + size], []
    for place in range(at, len(data) - _RECORD.size + 1, _RECORD.size):
        serial, kind, start, end, score = _RECORD.unpack_from(data, place)
        if not (1 <= kind <= len(ENTITIES) and start < end <= size):
            raise fault
        items.append({"id": serial, "type_id": kind, "type": ENTITIES[kind - 1], "start": start, "end": end, "score": score})
    return original.decode("utf-8", "replace"), items


def decode(credential: str | None) -> dict:
    """Either form; an empty credential has nothing to restore."""
    if not credential:
        return {"original": "", "items": []}
    try:
        data = base64.b64decode(credential, validate=True)
    except ValueError as error:
        raise ValueError("a credential is base64") from error
    if (len(data) >= 8 and struct.unpack_from("<I", data)[0] == len(data)) or not data.strip().startswith(b"{"):
        original, items = unpack(data)
    else:
        body = json.loads(data)
        original = body.get("original") or ""
        items = [{"id": i["id"], "type_id": i["type"], "type": ENTITIES[i["type"] - 1] if 1 <= i["type"] <= len(ENTITIES) else None, "start": i["start"], "end": i["end"], "score": i["score"]} for i in body.get("items") or []]
    return {"original": original, "items": items}


def _encoded(items: pa.Array, originals: pa.Array) -> pa.Array:
    made = []
    for own, original in zip(items.to_pylist(), originals, strict=True):
        data = original.as_py() or b"" if own else b""
        inside = lambda i: 0 <= i["start"] < i["end"] <= len(data)
        made.append(None if own is None else base64.b64encode(pack([i | {"text": data[i["start"] : i["end"]] if inside(i) else None} for i in own])).decode())
    return pa.array(made, pa.string())


def _decoded(credentials: pa.Array) -> pa.Array:
    return pa.array([decode(c) for c in credentials.to_pylist()], _META)


def encode_binary(meta: Column) -> Column:
    """Null for a null meta. Of texts without items nothing goes to Python."""
    items = F.when(meta.isNotNull(), F.coalesce(meta["items"], F.array().cast(f"array<{ITEM}>")))
    return arrow_udf(_encoded, "string")(items, F.when(F.size(items) > 0, meta["original"].cast("binary")))


def decode_credential(credential: Column) -> Column:
    """Either form."""
    return arrow_udf(_decoded, META)(credential)


def decode_json(credential: Column) -> Column:
    """Native: the JSON form only; null if it is no such credential."""
    body = F.from_json(F.decode(F.unbase64(credential), "UTF-8"), "original string, items array<struct<id:bigint,type:int,start:int,end:int,score:float>>")
    kind = lambda i: F.get(F.array(*[F.lit(x) for x in ENTITIES]), i["type"] - 1)
    items = F.transform(body["items"], lambda i: F.struct(i["id"].alias("id"), i["type"].cast("tinyint").alias("type_id"), kind(i).alias("type"), i["start"].alias("start"), i["end"].alias("end"), i["score"].alias("score")).cast(ITEM))
    return F.struct(body["original"].alias("original"), items.alias("items"))
