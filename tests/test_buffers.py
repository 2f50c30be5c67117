"""Pages as bytes: layouts against struct's, round trips, and bytes that aren't pages."""

import struct
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators import buffers as B
from cairn.operators.positional import FRAG, OFF


def frame(spark, values, kind):
    return spark.createDataFrame([(i // 3, i % 3, v) for i, v in enumerate(values)], f"{FRAG} int, {OFF} long, v {kind}").repartition(3)


def back(df, column="v"):
    return [r[column] for r in df.orderBy(FRAG, OFF).collect()]


@pytest.mark.parametrize(
    ("stored", "given_as", "values", "code"),
    [
        ("int8", "tinyint", [-128, 0, 127, 5], "b"),
        ("uint16", "int", [0, 65535, 258, 1], "H"),
        ("uint32", "bigint", [0, 2**32 - 1, 2**31, 1], "I"),
        ("uint64", "decimal(20,0)", [Decimal(2**64 - 1), Decimal(0), Decimal(2**53 + 1), Decimal(7)], "Q"),
        ("int64", "bigint", [-(2**63), 2**63 - 1, 0, -1], "q"),
        ("float16", "float", [1.5, -0.25, 65504.0, 0.0], "e"),
        ("float32", "float", [1.5, -0.25, 3.0, float("inf")], "f"),
        ("float64", "double", [0.1, -0.2, 1e300, 0.0], "d"),
    ],
)
def test_flat(spark, stored, given_as, values, code):
    pages = B.fixed_pack(frame(spark, values, given_as), {"v": stored})
    held = [bytes(r.page) for r in pages.orderBy(FRAG).collect()]
    assert held == [struct.pack(f"<{len(p)}{code}", *(int(x) if code in "bHIQq" else x for x in p)) for p in (values[:3], values[3:])]
    assert back(B.fixed_unpack(pages, {"v": stored})) == values


def test_packed_rows_with_lists(spark):
    types = {"x": "int16", "y": "float64", "l": "float32[3]"}
    rows = [(0, 1, 7, 0.5, [1.0, 2.0, 3.0]), (0, 0, -2, 1.5, [4.0, 5.0, 6.0])]
    df = spark.createDataFrame(rows, f"{FRAG} int, {OFF} long, x smallint, y double, l array<float>")
    pages = B.fixed_pack(df, types)
    assert bytes(pages.first().page) == struct.pack("<hdfff", -2, 1.5, 4, 5, 6) + struct.pack("<hdfff", 7, 0.5, 1, 2, 3)
    assert [tuple(r) for r in B.fixed_unpack(pages, types).orderBy(OFF).collect()] == rows[::-1]


def test_refusals(spark):
    with pytest.raises(Exception, match="holds nulls"):
        B.fixed_pack(frame(spark, [1, None], "int"), {"v": "int32"}).collect()
    with pytest.raises(Exception, match="beyond uint8"):
        B.fixed_pack(frame(spark, [256], "int"), {"v": "uint8"}).collect()
    with pytest.raises(Exception, match="lists of 2"):
        B.fixed_pack(frame(spark, [[1.0], [1.0, 2.0, 3.0]], "array<float>"), {"v": "float32[2]"}).collect()
    with pytest.raises(ValueError, match="no fixed-width"):
        B.fixed_pack(frame(spark, ["a"], "string"), {"v": "string"})
    odd = spark.createDataFrame([(0, bytearray(b"abc"))], f"{FRAG} int, page binary")
    with pytest.raises(Exception, match="rows of 2 bytes"):
        B.fixed_unpack(odd, {"v": "int16"}).collect()
    with pytest.raises(Exception, match="fewer than 25"):
        B.bits_unpack(odd.withColumn("n", F.lit(25))).collect()
    assert B.fixed_pack(frame(spark, [], "int"), {"v": "int32"}).collect() == []


def test_bits(spark):
    values = [True, False, None, True, True]
    pages = B.bits_pack(frame(spark, values, "boolean"), "v")
    assert [(r.n, bytes(r.page)) for r in pages.orderBy(FRAG).collect()] == [(3, b"\x01"), (2, b"\x03")]
    assert back(B.bits_unpack(pages), "value") == [True, False, False, True, True]


@pytest.mark.parametrize(("stored", "given_as", "values"), [("int32", "int", [None, 7, None, None, None, None, 5, 6]), ("float64", "double", [0.5, None, 2.0]), ("uint64", "decimal(20,0)", [None, Decimal(2**64 - 1)])])
def test_nulls(spark, stored, given_as, values):
    pages = B.nullable_pack(frame(spark, values, given_as), "v", stored)
    assert back(B.nullable_unpack(pages, stored), "value") == values
    assert back(B.nullable_unpack(B.decompress(B.compress(pages, "lz4"), "lz4"), stored), "value") == values
    with pytest.raises(Exception, match="values of"):
        B.nullable_unpack(pages.withColumn("page", F.concat("page", "page", F.unhex(F.lit("00" * 8)))), stored).collect()


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=2000), st.sampled_from(B.CODECS))
def test_compressed(data, codec):
    made = B.compressed(data, codec)
    assert made[:8] == struct.pack("<Q", len(data)) and B.plain(made, codec) == data
    for odd in (made[:5], struct.pack("<Q", len(data) + 1) + made[8:], struct.pack("<Q", 1 << 40) + made[8:], made[:8] + b"no frame"):
        with pytest.raises(ValueError):
            B.plain(odd, codec)


def test_compressed_columns(spark):
    df = spark.createDataFrame([(1, "a" * 999), (2, ""), (3, None)], "id int, v string")
    for codec in B.CODECS:
        small = B.compress(df, codec, "v")
        assert small.filter("id = 1").select(F.length("v")).first()[0] < 100
        assert [r.v for r in B.decompress(small, codec, "v").withColumn("v", F.col("v").cast("string")).orderBy("id").collect()] == ["a" * 999, "", None]
    with pytest.raises(ValueError, match="no codec"):
        B.compress(df, "snappy", "v")
