"""Language, credentials, sources, calls and streams."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions.language import detect, is_chinese
from palimpsest.operators.calls import call_frame
from palimpsest.operators.credentials import decode, decode_credential, decode_json, encode_binary, encode_json, pack, unpack
from palimpsest.operators.masking import mask_frame
from palimpsest.sources.shipping import ship
from palimpsest.sources.texts import as_bool, guarded, parse_key_file, read_below, read_json_batch, read_whole_texts, setting, spread, write_json_batch
from palimpsest.streaming.masking import mask_stream, start_masking


def test_language(spark):
    cases = {"hello": "en", "今日は晴れ": "ja", "안녕하세요": "ko", "这是中文": "zh-Hans", "這裡是中文": "zh-Hant", "": "", "123": "", "Привет": "en", "ｰ": "ja", "中 with many Latin letters": "en"}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r.t: r.l for r in df.select("t", detect(F.col("t")).alias("l")).collect()} == cases
    df = spark.createDataFrame([("zh",), ("ZH-hant",), ("zh_TW",), ("zhx",), (None,)], "l string")
    assert [r.c for r in df.select(is_chinese(F.col("l")).alias("c")).collect()] == [True, True, True, False, False]


def test_credentials(spark):
    df = spark.createDataFrame([(1, "é a@b.cd 1234"), (2, "none"), (3, None)], "i int, text string")
    out = mask_frame(df).select("i", "meta", encode_json(F.col("meta")).alias("j"), encode_binary(F.col("meta")).alias("b"))
    back = {r.i: r for r in out.select("i", decode_json(F.col("j")).alias("j"), decode_credential(F.col("b")).alias("b"), decode_credential(F.col("j")).alias("e")).collect()}
    assert [i.asDict()["type"] for i in back[1].j["items"]] == ["EMAIL_ADDRESS", "VERIFICATION_CODE"]
    assert back[1].j.original == "é a@b.cd 1234" and back[1].e == back[1].j
    assert back[1].b.original == "a@b.cd1234" and [(i.start, i.end) for i in back[1].b["items"]] == [(0, 6), (6, 10)]
    assert back[2].b["items"] == []


def test_binary_form():
    data = pack([{"id": 1, "type_id": 2, "text": b"a@b", "score": 0.9}])
    assert len(data) == 12 + 3 + 20 and unpack(data)[0] == "a@b"
    for broken in (data[:-1], data + b"\0", b"\0" * 8, data[:16].ljust(len(data), b"\xff")):
        with pytest.raises(ValueError):
            unpack(broken)
    for item in ({"id": 1, "type_id": 2, "text": None, "score": 1.0}, {"id": 1, "type_id": 99, "text": b"x", "score": 1.0}):
        with pytest.raises(ValueError):
            pack([item])
    assert decode("") == {"original": "", "items": []}
    with pytest.raises(ValueError):
        decode("%%%")


def test_sources(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("line\nnext a@b.cd")
    assert read_whole_texts(spark, str(tmp_path / "a.txt")).first().text == "line\nnext a@b.cd"
    (tmp_path / "b.json").write_text(json.dumps([{"text": "x", "language": "en"}, {"text": None}]))
    rows = read_json_batch(spark, str(tmp_path / "b.json")).orderBy("item").collect()
    assert [(r.item, r.text, r.language) for r in rows] == [(0, "x", "en"), (1, None, None)]
    write_json_batch(spark.createDataFrame([("m", "c")], "masked string, meta string"), str(tmp_path / "out"), {"text": "masked", "maskMeta": "meta"})
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value) == {"text": "m", "maskMeta": "c"}
    assert [r.error.code if r.error else 0 for r in guarded(spark.createDataFrame([("a",), (None,)], "text string")).collect()] == [0, 400]
    monkeypatch.setenv("PALIMPSEST_MODEL", "env")
    assert setting("model", None, {"model": "file"}) == "env" and setting("model", "flag") == "flag"
    assert setting("port", None, {"port": "7"}, 1, int) == 7 and as_bool("T") and not as_bool("0")
    assert parse_key_file(b'{"openai-api-key": "k", "openai_model": "m"}') == {"api_key": "k", "base_url": "", "model": "m"}
    assert read_below(str(tmp_path), "a.txt").startswith(b"line")
    for path in ("../x", "/etc/passwd", ""):
        with pytest.raises(ValueError):
            read_below(str(tmp_path), path)


def test_small_tables_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    assert spread(spark.range(10, numPartitions=cores + 3)).rdd.getNumPartitions() == cores + 3


def test_shipped_modules_serve_the_workers(spark):
    ship(spark)
    ship(spark)

    def where(batches):
        import sys

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"path": [" ".join(sys.path)] * batch.num_rows})

    assert "palimpsest-modules.zip" in spark.range(1).mapInArrow(where, "path string").first().path


def test_call(spark):
    df = spark.createDataFrame([(1, "write to a@b.cd"), (2, None)], "i int, text string")
    got = {r.i: r for r in call_frame(df, lambda model, prompt, temperature: f"{model}: {prompt}", "m").collect()}
    assert got[1].reply == "m: write to __PII_EMAIL_ADDRESS_1__" and got[1].restored == "m: write to a@b.cd"
    assert got[2].restored is None


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.cd"), (2, "none")], "i int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i int, text string").parquet(str(tmp_path / "in"))
    assert mask_stream(stream).isStreaming
    start_masking(stream, "i", str(tmp_path / "masked"), str(tmp_path / "meta"), str(tmp_path / "check")).awaitTermination()
    assert {r.i: r.masked for r in spark.read.parquet(str(tmp_path / "masked")).collect()} == {1: "__PII_EMAIL_ADDRESS_1__", 2: "none"}
    assert spark.read.parquet(str(tmp_path / "meta")).count() == 2
