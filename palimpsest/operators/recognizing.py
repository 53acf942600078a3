"""Token models as recognisers of a masking plan."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from palimpsest.functions.entities import TYPE_ID
from palimpsest.functions.language import is_chinese
from palimpsest.functions.spans import SPAN
from palimpsest.functions.token_models import TokenModel, load_folder

Recognizer = Callable[[Column, Column], Column]
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float32()), ("ord", pa.int32()), ("type_id", pa.int8()), ("source", pa.string())]))
_started: dict[str, Callable] = {}


def recognizer(model: TokenModel, languages: Callable[[Column], Column] | None = None, order: int = 10_000) -> Recognizer:
    """Spans of a token model. languages says which texts it is for; others never reach Python's model, only as nulls.

    Chinese texts other than in traditional script go through the model's converter, if it has one.
    """

    def run(texts: pa.Array, convert: pa.Array) -> pa.Array:
        if model.name not in _started:
            _started[model.name] = model.start()
        recognise = _started[model.name]
        out = []
        for text, own in zip(texts, convert, strict=True):
            found = recognise(text.as_py() or "", bool(own.as_py()))
            out.append([{"start": f.start, "end": f.end, "score": f.score, "ord": order + i, "type_id": TYPE_ID[f.kind], "source": model.name} for i, f in enumerate(found)])
        return pa.array(out, _SPANS)

    def spans(text: Column, language: Column) -> Column:
        chosen = F.when(languages(language), text) if languages else text
        return arrow_udf(run, f"array<{SPAN}>")(chosen, is_chinese(language) & (language != "zh-Hant"))

    return spans


def not_chinese(language: Column) -> Column:
    return ~is_chinese(language)


def routed(other: TokenModel | None, chinese: TokenModel | None) -> tuple[Recognizer, ...]:
    """One model for Chinese texts, one for all others."""
    out = []
    if other:
        out.append(recognizer(other, not_chinese, 10_000))
    if chinese:
        out.append(recognizer(chinese, is_chinese, 20_000))
    return tuple(out)


def load_or_none(name: str, folder: str | None, **options) -> TokenModel | None:
    """The model of a folder; without one, a warning and none: rules alone recognise then."""
    if not folder:
        return None
    try:
        return load_folder(name, folder, **options)
    except FileNotFoundError as error:
        logging.getLogger(__name__).warning("no model %s, rules only: %s", name, error)
        return None
