"""Where texts come from and go to: plain files, JSON batches, tables; and settings from several places."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest text of a request, largest settings file. Fixed values.
MAX_TEXT, MAX_FILE = 32 << 20, 1 << 20


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file is one text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores. A table that comes in fewer splits than there are cores is dealt anew; a larger one has no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_json_batch(spark: SparkSession, path: str) -> DataFrame:
    """(item, text, language, maskMeta) of JSON arrays of such objects; item is the place in its array."""
    items = "array<struct<text:string,language:string,maskMeta:string>>"
    parsed = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", items).alias("items"))
    return parsed.select("path", F.posexplode("items").alias("item", "row")).select("path", "item", "row.*")


def write_json_batch(df: DataFrame, path: str, columns: Mapping[str, str]) -> None:
    """One JSON object a row; columns maps keys to columns."""
    df.select(F.to_json(F.struct(*[F.col(c).alias(k) for k, c in columns.items()])).alias("value")).write.text(path)


def guarded(df: DataFrame, text_col: str = "text", error_col: str = "error", max_bytes: int | None = None) -> DataFrame:
    """df with an error (message, code) for each row whose text is missing or longer than max_bytes (MAX_TEXT), else null."""
    fault = lambda message, code: F.struct(F.lit(message).alias("message"), F.lit(code).alias("code"))
    return df.withColumn(error_col, F.when(F.col(text_col).isNull(), fault("no text", 400)).when(F.octet_length(text_col) > (MAX_TEXT if max_bytes is None else max_bytes), fault("text too long", 413)))


def resolve(*values: Any, default: Any = None, convert=None) -> Any:
    """The first value that is set (not None, not empty), in the order flag, environment, file; else the default."""
    for value in values:
        if value is not None and value != "":
            return convert(value) if convert else value
    return default


def setting(name: str, flag: Any = None, file: Mapping[str, Any] | None = None, default: Any = None, convert=None, prefix: str = "PALIMPSEST_") -> Any:
    return resolve(flag, os.environ.get(prefix + name.upper()), (file or {}).get(name), default=default, convert=convert)


def as_bool(value: Any) -> bool:
    if isinstance(value, bool):
        return value
    text = str(value).strip().lower()
    if text not in ("1", "t", "true", "0", "f", "false"):
        raise ValueError(f"no boolean: {value!r}")
    return text in ("1", "t", "true")


def within(root: str, relative: str) -> Path:
    """A path below root, links resolved; anything else is an error."""
    if not relative or PurePosixPath(relative).is_absolute() or ".." in PurePosixPath(relative).parts:
        raise ValueError("the path must be relative and stay below its root")
    base = Path(root).resolve(strict=True)
    path = (base / relative).resolve(strict=True)
    if not path.is_relative_to(base):
        raise ValueError("the path leaves its root")
    return path


def read_below(root: str, relative: str, limit: int = MAX_FILE) -> bytes:
    """A regular file of at most `limit` bytes below root."""
    path = within(root, relative)
    if not path.is_file():
        raise ValueError("not a regular file")
    with path.open("rb") as file:
        data = file.read(limit + 1)
    if len(data) > limit:
        raise ValueError("the file is too long")
    return data


def parse_key_file(data: bytes) -> dict[str, str]:
    """key, base_url and model from a JSON key file; hyphens and underscores in its keys are alike."""
    held = {str(k).replace("-", "_").lower(): v for k, v in json.loads(data).items()}
    out = {name: str(held.get(f"openai_{name}") or held.get(name) or "").strip() for name in ("api_key", "base_url", "model")}
    if not out["api_key"]:
        raise ValueError("the key file has no key")
    return out
