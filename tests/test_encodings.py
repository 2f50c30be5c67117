"""Round trips of encodings and levels."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import encodings as E
from cairn.operators import repdef as R
from cairn.operators.positional import FRAG, OFF


def rows(spark, values, kind, size=64):
    return spark.createDataFrame([(i // size, i % size, v) for i, v in enumerate(values)], f"{FRAG} int, {OFF} long, v {kind}")


def back(df, size=64):
    out = {(r[FRAG], r[OFF]): r["value"] for r in df.collect()}
    return [out[i // size, i % size] for i in range(len(out))]


RNG = random.Random(1)
VALUES = [RNG.choice([None, 1, 1, 1, 2]) for _ in range(300)] + [7] * 600


def test_rle(spark):
    df = rows(spark, VALUES, "int", 700)
    runs = E.rle_encode(df, "v")
    assert max(r.length for r in runs.collect()) <= 255
    assert back(E.rle_decode(runs), 700) == VALUES
    bad = spark.createDataFrame([(0, 0, 1, 0)], f"{FRAG} int, start long, value int, length long")
    with pytest.raises(Exception, match="no values"):
        E.rle_decode(bad).collect()


def test_dictionary(spark):
    df = rows(spark, ["a", "b", "a", "c", None, "b", "a"], "string")
    values = E.dictionary(df, "v")
    assert sorted(map(tuple, values.collect())) == [(0, "a"), (1, "b"), (2, "c")]
    assert back(E.dictionary_decode(E.dictionary_encode(df, "v", values), values)) == ["a", "b", "a", "c", None, "b", "a"]


@pytest.mark.parametrize("width", [1, 3, 7, 12, 17, 31, 32])
def test_bitpacking(spark, width):
    values = [RNG.randrange(1 << width) for _ in range(2050)]
    df = rows(spark, values, "long", 2050)
    sizes = df.groupBy(FRAG).agg(F.count(F.lit(1)).alias("rows"))
    assert back(E.bitunpack(E.bitpack(df, "v", width), sizes, width), 2050) == values
    signed = [v - (1 << width) if v >> (width - 1) else v for v in values]
    assert back(E.bitunpack(E.bitpack(df, "v", width), sizes, width, signed=True), 2050) == signed


def test_unpacked_rows_are_never_broadcast(spark):
    df = rows(spark, [v % 32 for v in range(3000)], "long", 3000)
    words, sizes = E.bitpack(df, "v", 5), df.groupBy(FRAG).agg(F.count(F.lit(1)).alias("rows"))
    plan = E.bitunpack(words, sizes, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan.split("Join ", 1)[0]
    big = spark.range(1).selectExpr(f"0 AS {FRAG}", "40000 AS rows")
    with pytest.raises(Exception, match="lacks words"):
        E.bitunpack(words, big, 5).collect()
    assert back(E.bitunpack(E.bitpack(rows(spark, [None] * 40 + [3], "long"), "v", 2), spark.range(1).selectExpr(f"0 AS {FRAG}", "41 AS rows"), 2)) == [0] * 40 + [3]


def test_bit_width(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (255,), (256,)], "m long")
    assert [r.w for r in df.select(E.bit_width(F.col("m")).alias("w")).collect()] == [1, 1, 2, 8, 9]


def test_validity(spark):
    df = rows(spark, VALUES, "int")
    validity, dense = E.validity_split(df, "v")
    assert back(E.validity_expand(validity, dense)) == VALUES
    nulls = rows(spark, [None] * 5, "int")
    assert back(E.validity_expand(*E.validity_split(nulls, "v"))) == [None] * 5


def test_constants(spark):
    df = spark.createDataFrame([(0, 0, 42, None, 1, 1), (0, 1, 42, None, 2, None)], f"{FRAG} int, {OFF} long, a int, b int, c int, d int")
    assert {r.column: (r.kind, r.value) for r in E.constants(df, ["a", "b", "c", "d"]).collect()} == {"a": ("constant", "42"), "b": ("null", None), "c": ("varied", None), "d": ("constant with nulls", "1")}


def test_blob_descriptors_and_offsets(spark):
    df = rows(spark, ["ab", "", None, "é", "x"], "string")
    assert [(r.position, r.size) for r in E.blob_descriptors(df, "v").orderBy(OFF).collect()] == [(0, 2), (0, 0), (1, 0), (2, 2), (4, 1)]
    assert [r.end for r in E.offsets_encode(df, "v").orderBy(OFF).collect()] == [2, 2, 2 + 6, 4, 5]


def test_packed_bytes_and_fixed_lists(spark):
    df = spark.createDataFrame([(0, 0, 1, 2**40), (0, 1, 65535, 0)], f"{FRAG} int, {OFF} long, a int, b long")
    packed = E.pack_fixed(df, {"a": 2, "b": 6})
    assert {r.n for r in packed.select(F.octet_length("bytes").alias("n")).collect()} == {8}
    assert [(r.a, r.b) for r in E.unpack_fixed(packed, {"a": 2, "b": 6}).orderBy(OFF).collect()] == [(1, 2**40), (65535, 0)]
    lists = rows(spark, [[1.0, None, 3.0], [4.0, 5.0, 6.0]], "array<double>")
    items = E.fixed_lists_flatten(lists, "v")
    assert [r["items"] for r in E.fixed_lists_rebuild(items, 3).orderBy(OFF).collect()] == [[1.0, None, 3.0], [4.0, 5.0, 6.0]]
    with pytest.raises(Exception, match="another size"):
        E.fixed_lists_rebuild(items, 2).collect()


LISTS = [[1, 2], None, [], [None, 5], [None], list(range(50))]


def test_levels(spark):
    df = spark.createDataFrame(list(enumerate(LISTS)), "k int, v array<int>")
    levels = R.shred(df, ["k"], "v")
    found = {(r.k, r.pos): (r.rep, r["def"]) for r in levels.filter("k < 5").collect()}
    assert found == {(0, 0): (1, 0), (0, 1): (0, 0), (1, 0): (1, 2), (2, 0): (1, 3), (3, 0): (1, 1), (3, 1): (0, 0), (4, 0): (1, 1)}
    assert [r["items"] for r in R.assemble(levels, ["k"]).orderBy("k").collect()] == LISTS
    plain = spark.createDataFrame([(0, [1, 2])], "k int, v array<int>")
    only = R.Layer(False, False, False)
    assert R.assemble(R.shred(plain, ["k"], "v", only), ["k"], only).first()["items"] == [1, 2]
    with pytest.raises(Exception, match="null items"):
        R.shred(spark.createDataFrame([(0, [None])], "k int, v array<int>"), ["k"], "v", only).collect()


def test_layer_levels():
    assert [R.Layer().level(k) for k in ("null_items", "null_lists", "empty_lists")] == [1, 2, 3]
    assert R.Layer(null_items=False).level("empty_lists") == 2 and R.Layer(empty_lists=False).level("empty_lists") is None
