"""Calls to a model: several at once, and their figures in one pass."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.calls import call_frame, call_with_figures

TEXTS = [(i, f"number {i}: a{i}@b.cd" if i % 4 else None) for i in range(40)]


def slow(model, prompt, temperature):
    time.sleep(0.05 * (1 + len(prompt) % 3))
    return f"{prompt} from {threading.current_thread().name.split('-')[0]}"


def failing(model, prompt, temperature):
    if "number 7" in prompt:
        raise RuntimeError("no reply")
    return prompt


def test_several_calls_at_once(spark):
    frame = spark.createDataFrame(TEXTS, "i int, text string").coalesce(1)
    began = time.perf_counter()
    rows = {r.i: r for r in call_frame(frame, slow, concurrency=10).collect()}
    assert time.perf_counter() - began < 30
    for i, text in TEXTS:
        assert rows[i].restored == (None if text is None else f"{text} from ThreadPoolExecutor")
    # Calls overlap: together they took longer than the stage.
    assert sum(r.llm_ms for r in rows.values()) > 30 * 50


def test_a_failing_call_fails_its_task(spark):
    with pytest.raises(Exception, match="no reply"):
        call_frame(spark.createDataFrame(TEXTS, "i int, text string"), failing).collect()


def test_figures_of_one_pass(spark, tmp_path):
    frame = spark.createDataFrame(TEXTS, "i int, text string").repartition(3)
    out, figures = call_with_figures(frame, client=slow)
    out.write.parquet(f"{tmp_path}/out")
    told, held = figures.get, spark.read.parquet(f"{tmp_path}/out")
    total, longest = held.agg(F.sum("llm_ms"), F.max("llm_ms")).first()
    assert (told["rows"], told["replies"]) == (40, 30) and abs(told["llm_ms"] - total) < 1e-6 and told["longest_ms"] == longest
    out, figures = call_with_figures(frame.limit(0))
    out.collect()
    assert (figures.get["rows"], figures.get["llm_ms"]) == (0, 0.0)
