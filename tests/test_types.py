import pytest
from pyspark.sql import types as T

from cairn.functions import logical_types as L


def test_names():
    assert L.to_spark("uint64") == T.DecimalType(20, 0) and L.to_spark("decimal:256:38:6") == T.DecimalType(38, 6)
    assert L.to_spark("timestamp:us:UTC") == T.TimestampType() and L.to_spark("timestamp:ms:-") == T.TimestampNTZType()
    assert L.to_spark("timestamp:ns") == T.LongType() and L.to_spark("time32:ms") == T.LongType() and L.to_spark("duration:ms") == T.DayTimeIntervalType()
    assert L.to_spark("fixed_size_list:double:3") == T.ArrayType(T.DoubleType()) and L.to_spark("dict:int64:int32:false") == T.LongType()
    assert L.to_spark("fixed_size_list:decimal:128:10:2:3") == T.ArrayType(T.DecimalType(10, 2))
    for bad in ("map", "decimal:256:40:2", "interval", "union", "fixed_size_binary:0", "timestamp:h"):
        with pytest.raises(ValueError):
            L.to_spark(bad)


def test_names_come_back():
    for kind in (T.LongType(), T.StringType(), T.BooleanType(), T.DateType(), T.FloatType(), T.DecimalType(12, 3), T.TimestampType(), T.TimestampNTZType(), T.BinaryType(), T.DayTimeIntervalType()):
        assert L.to_spark(L.to_logical(kind)) == kind


def test_field_tree():
    fields = [
        {"id": 0, "name": "a", "type": "int32", "nullable": False}, {"id": 1, "name": "l", "type": "list.struct"},
        {"id": 2, "parent_id": 1, "name": "item", "type": "struct"}, {"id": 3, "parent_id": 2, "name": "x", "type": "string"},
    ]
    assert L.to_struct_type(fields).simpleString() == "struct<a:int,l:array<struct<x:string>>>"


def test_checks(spark):
    df = spark.createDataFrame([(255, [1.0, 2.0], b"abcd"), (None, None, None)], "u int, l array<double>, b binary")
    assert L.conform(df, {"u": "uint8", "l": "fixed_size_list:double:2", "b": "fixed_size_binary:4"}).count() == 2
    for wrong in ({"u": "fixed_size_list:double:3"}, ):
        with pytest.raises(Exception):
            L.conform(df, wrong).collect()
    for name, kind in (("l", "fixed_size_list:double:3"), ("b", "fixed_size_binary:5")):
        with pytest.raises(Exception, match="value is not"):
            L.conform(df, {name: kind}).collect()
    with pytest.raises(Exception, match="value is not"):
        L.conform(spark.createDataFrame([(-1,)], "u int"), {"u": "uint8"}).collect()
