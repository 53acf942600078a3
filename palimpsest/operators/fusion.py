"""Chinese addresses among spans: fused ones replace the pieces they were made of."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.addresses import Seed, fuse, has_private_detail
from palimpsest.functions.entities import TYPE_ID
from palimpsest.functions.spans import SPAN, covered_by_any, no_spans, overlaps_any

_KINDS = {TYPE_ID["PHYSICAL_ADDRESS"]: "address", TYPE_ID["ORGANIZATION"]: "organization"}
_FUSED = pa.struct([("addresses", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float32())]))), ("private", pa.list_(pa.bool_()))])


_ADDRESS = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.FloatType())])
_MADE = T.StructType([T.StructField("addresses", T.ArrayType(_ADDRESS)), T.StructField("private", T.ArrayType(T.BooleanType()))])


def with_fused(df: DataFrame, name: str, text_col: str, spans_col: str, chinese_col: str) -> DataFrame:
    """df with the addresses fused from each Chinese text's spans, and for each span whether it is private by itself."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, _MADE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda column: batch.column(batch.schema.get_field_index(column))
            made = []
            for text, spans, chinese in zip(get(text_col), get(spans_col), get(chinese_col), strict=True):
                own = (spans.as_py() or []) if chinese.as_py() else []
                if not any(s["type_id"] in _KINDS for s in own):
                    made.append({"addresses": [], "private": [False] * len(own)})
                    continue
                data = (text.as_py() or "").encode()
                found = fuse(data, [Seed(_KINDS.get(s["type_id"], "other"), s["start"], s["end"], s["score"]) for s in own])
                made.append({"addresses": [a._asdict() for a in found], "private": [_KINDS.get(s["type_id"]) == "address" and has_private_detail(data, s["start"], s["end"]) for s in own]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, _FUSED)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def with_addresses(spans: Column, made: Column, fallback: bool = True, order: int = 100_000) -> Column:
    """spans after fusion. Addresses give way to fused ones that they touch; others stay only as a fallback, if private by
    themselves. Organizations within a fused address go."""
    address, organization = TYPE_ID["PHYSICAL_ADDRESS"], TYPE_ID["ORGANIZATION"]
    marked = F.zip_with(spans, made["private"], lambda s, p: F.struct(s.alias("span"), p.alias("private")))

    def stays(m: Column) -> Column:
        s = m["span"]
        kept = ~overlaps_any(s, made["addresses"]) & m["private"] if fallback else F.lit(False)
        return F.when(s["type_id"] == address, kept).when(s["type_id"] == organization, ~covered_by_any(s, made["addresses"])).otherwise(True)

    old = F.transform(F.filter(marked, stays), lambda m: m["span"])
    new = F.transform(made["addresses"], lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["score"].alias("score"), F.lit(order).alias("ord"), F.lit(address).cast("tinyint").alias("type_id"), F.lit("address").alias("source")).cast(SPAN))
    return F.concat(F.coalesce(old, no_spans()), F.coalesce(new, no_spans()))
