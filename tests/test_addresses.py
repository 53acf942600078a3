"""Chinese addresses: whole lines as seeds, and what becomes of pieces among other spans."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.addresses import Seed, fuse, has_private_detail
from palimpsest.functions.entities import Switches
from palimpsest.operators.masking import Options, mask_frame


def whole(line):
    data = line.encode()
    return [(round(a.score, 4), data[a.start : a.end].decode()) for a in fuse(data, [Seed("address", 0, len(data), 0.9)])]


@pytest.mark.parametrize(
    ("line", "score"),
    [("北京市朝阳区建国路 88 号", 0.9874), ("珠海市香洲路明月花园12栋508房", 0.9974), ("南京市鼓楼区中山北路50号之3金陵中心B座18层", 0.9949)],
)
def test_whole_lines(line, score):
    assert whole(line) == [(score, line)]


def test_coarse_addresses_are_none():
    assert whole("上海市浦东新区") == []
    assert not has_private_detail("上海市浦东新区".encode(), 0, 21)


def _with(spark, text, piece, kind, **options):
    data = text.encode()
    at = data.index(piece.encode())

    def recognizer(column, language):
        return F.when(column.isNotNull(), F.array(F.struct(F.lit(at).alias("start"), F.lit(at + len(piece.encode())).alias("end"), F.lit(0.9).cast("float").alias("score"), F.lit(500).alias("ord"), F.lit(kind).cast("tinyint").alias("type_id"), F.lit("t").alias("source"))))

    df = spark.createDataFrame([(text,)], "text string")
    return mask_frame(df, options=Options(recognizers=(recognizer,), addresses=True, switches=Switches.all(), **options)).first().masked


def test_piece_grows_to_its_address(spark):
    text = "地址是北京市朝阳区建国路88号国贸中心A座1208室。完"
    assert _with(spark, text, "北京市朝阳区", 1) == "地址是__PII_PHYSICAL_ADDRESS_1__。完"


def test_fallback_keeps_private_pieces(spark):
    text = "住在科技南十二路8-2号科兴科学园C座5层"
    piece = text[2:]
    assert _with(spark, text, piece, 1) in ("住在__PII_PHYSICAL_ADDRESS_1__",)


def test_other_languages_are_left_alone(spark):
    assert _with(spark, "Lives in Springfield now", "Springfield", 1) == "Lives in __PII_PHYSICAL_ADDRESS_1__ now"
