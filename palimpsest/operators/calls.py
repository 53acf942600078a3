"""The hop to a language model: mask, ask, restore, with the time that each stage took.

A client is any callable (model, prompt, temperature) -> reply; only masked text reaches it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from palimpsest.operators.masking import Options, fresh, mask_frame, restore_frame, restored, unclaimed

Client = Callable[[str, str, float], str]


def echo(model: str, prompt: str, temperature: float) -> str:
    """A client for tests: the prompt comes back."""
    return prompt


def asking(client: Client, model: str, temperature: float, concurrency: int = 8) -> Callable[[Column], Column]:
    """A function of a column of prompts that gives struct(reply, ms). Nothing but the prompts goes to Python.

    A task has up to `concurrency` calls under way at once; replies stay with their prompts. The first call that fails fails the task.
    """

    @arrow_udf("struct<reply:string,ms:double>")
    def ask(prompts: pa.Array) -> pa.Array:
        def one(prompt: str | None) -> tuple[str | None, float]:
            began = time.perf_counter()
            return (None if prompt is None else client(model, prompt, temperature)), (time.perf_counter() - began) * 1000

        with ThreadPoolExecutor(concurrency) as pool:
            answers = list(pool.map(one, prompts.to_pylist()))
        return pa.StructArray.from_arrays([pa.array([r for r, _ in answers], pa.string()), pa.array([ms for _, ms in answers], pa.float64())], ["reply", "ms"])

    return ask.asNondeterministic()


def call_frame(df: DataFrame, client: Client = echo, model: str = "", temperature: float = 0.0, text_col: str = "text", options: Options | None = None, language_col: str | None = None, concurrency: int = 8) -> DataFrame:
    """df with masked, reply, llm_ms and restored. A failing call fails its task: nothing goes out half-masked."""
    unclaimed(df, "masked", "reply", "llm_ms", "restored")
    meta = fresh(df, "meta")
    out = mask_frame(df, text_col, options, language_col, meta_col=meta)
    answer = fresh(out, "answer")
    out = out.withColumn(answer, asking(client, model, temperature, concurrency)(F.col("masked")))
    out = out.withColumn("reply", F.col(f"{answer}.reply")).withColumn("llm_ms", F.col(f"{answer}.ms"))
    return out.withColumn("restored", restored(F.col("reply"), F.col(f"{meta}.original"), F.col(f"{meta}.items"))).drop(meta, answer)


def call_with_figures(df: DataFrame, **how) -> tuple[DataFrame, Observation]:
    """call_frame's result, and figures that are there once it has been written or collected in whole: rows, replies, llm_ms in all and
    of the longest call. One pass, no table between; a task that is run again counts once."""
    figures = Observation()
    out = call_frame(df, **how)
    return out.observe(figures, F.count(F.lit(1)).alias("rows"), F.count("reply").alias("replies"), F.coalesce(F.sum("llm_ms"), F.lit(0.0)).alias("llm_ms"), F.max("llm_ms").alias("longest_ms")), figures


def call_in_stages(df: DataFrame, key: str, folder: str, client: Client = echo, model: str = "", temperature: float = 0.0, text_col: str = "text", options: Options | None = None, language_col: str | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(key, restored) and the time of each stage: mask_ms, llm_ms, restore_ms and total_ms.

    Each stage is written below folder before the next one begins, so that a failed one need not ask again for what is there.
    """
    spark = df.sparkSession
    spent: dict[str, float] = {}

    def stage(name: str, made: DataFrame) -> DataFrame:
        began = time.perf_counter()
        made.write.mode("overwrite").parquet(f"{folder}/{name}")
        spent[f"{name}_ms"] = (time.perf_counter() - began) * 1000
        return spark.read.parquet(f"{folder}/{name}")

    masks = stage("mask", mask_frame(df, text_col, options, language_col).select(key, "masked", "meta"))
    replies = stage("llm", masks.select(key, asking(client, model, temperature)(F.col("masked"))["reply"].alias("reply")))
    out = stage("restore", restore_frame(replies, masks, key).select(key, "restored"))
    return out, spent | {"total_ms": sum(spent.values())}
