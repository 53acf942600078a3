"""JSON batches as a source and a sink: round trips, faults, jobs that fail midway."""

import json
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from palimpsest.operators.masking import mask_frame
from palimpsest.sources import batches
from palimpsest.sources.batches import JsonBatches

ITEMS = [{"text": "mail a@b.cd \"quoted\" \\ \n ünï 🙏", "language": "en"}, {"text": None, "maskMeta": "x"}, {"text": "", "other": [1, {"a": None}]}, {"text": "otp: 12345", "maskMeta": {"k": [1]}}]


@pytest.fixture
def source(spark):
    spark.dataSource.register(JsonBatches)
    return spark


def files(folder):
    return sorted(f for f in os.listdir(folder) if not f.startswith("."))


def test_reading_deals_files_to_tasks(source, tmp_path, monkeypatch):
    for i in range(5):
        (tmp_path / f"b{i}.json").write_text(json.dumps(ITEMS[i % 2 :]), encoding="utf-8")
    (tmp_path / "_hidden.json").write_text("no json")
    (tmp_path / "empty.json").write_text("[]")
    read = source.read.format("json_batches").load(str(tmp_path))
    rows = sorted(read.collect())
    assert len(rows) == 18 and [(r.item, r.text, r.language, r.maskMeta) for r in rows[:4]] == [(0, ITEMS[0]["text"], "en", None), (1, None, None, "x"), (2, "", None, None), (3, "otp: 12345", None, '{"k": [1]}')]
    assert sorted(source.read.format("json_batches").load(f"file://{tmp_path}").collect()) == rows
    monkeypatch.setattr(batches, "PARTITION_BYTES", 1)
    assert len(batches.BatchReader(str(tmp_path), [], 1 << 20).partitions()) == 6
    assert source.read.format("json_batches").load(f"{tmp_path}/b1.json").count() == 3


@pytest.mark.parametrize("text", ['{"text": "x"}', "[1]", "[", "x"])
def test_faulty_batches_are_errors(source, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(Exception):
        source.read.format("json_batches").load(str(tmp_path)).collect()


def test_a_long_batch_is_an_error(source, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps([{"text": "x" * 100}]))
    with pytest.raises(Exception, match="a batch of"):
        source.read.format("json_batches").option("maxBytes", 50).load(str(tmp_path)).count()


def test_writing_and_reading_back(source, tmp_path):
    folder = f"{tmp_path}/out"
    texts = source.createDataFrame([(i, x["text"]) for i, x in enumerate(ITEMS * 5)], "i int, text string").repartition(3)
    out = mask_frame(texts).select("i", F.col("masked").alias("text"), F.to_json("meta").alias("maskMeta"))
    out.write.format("json_batches").mode("append").save(folder)
    assert len(files(folder)) == 3 and not [f for f in files(folder) if f.startswith("_")]
    back = lambda: source.read.format("json_batches").load(folder)  # noqa: E731  # the files are listed when it is loaded
    told = lambda rows: sorted((r.text or "", r.maskMeta or "") for r in rows)
    assert told(back().collect()) == told(out.collect()) and any("__PII_EMAIL_ADDRESS_1__" in text for text, _ in told(back().collect()))
    out.limit(1).write.format("json_batches").mode("append").save(folder)
    assert back().count() == 21
    out.limit(2).write.format("json_batches").mode("overwrite").save(folder)
    assert back().count() == 2


def test_a_failed_job_leaves_nothing(source, tmp_path):
    folder = f"{tmp_path}/out"
    frame = source.range(40).repartition(4).selectExpr("id", "cast(id as string) text")
    frame.write.format("json_batches").mode("append").save(folder)
    before = files(folder)
    broken = frame.withColumn("text", F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            broken.write.format("json_batches").mode(mode).save(folder)
        assert files(folder) == before and source.read.format("json_batches").load(folder).count() == 40


def test_a_task_writes_several_batches_when_one_would_be_too_long(source, tmp_path):
    folder = f"{tmp_path}/out"
    frame = source.range(200).coalesce(1).selectExpr("id", "concat(repeat('ü', 20), id) text")
    frame.write.format("json_batches").option("maxBytes", 1000).mode("append").save(folder)
    sizes = [os.path.getsize(f"{folder}/{f}") for f in files(folder)]
    assert len(sizes) > 1 and 900 < max(sizes) <= 1000
    back = source.read.format("json_batches").option("maxBytes", 1000).load(folder)
    assert sorted(r.text for r in back.collect()) == sorted(r.text for r in frame.collect())
    frame.limit(2).coalesce(1).write.format("json_batches").option("maxBytes", 10).mode("overwrite").save(folder)
    assert len(files(folder)) == 2 and source.read.format("json_batches").load(folder).count() == 2


def test_no_task_writes_after_its_job_has_failed(tmp_path):
    writer = batches.BatchWriter(f"{tmp_path}/out", False)
    writer.abort([])
    with pytest.raises(Exception):
        writer.write(iter([Row(text="late")]))
    assert files(f"{tmp_path}/out") == []
