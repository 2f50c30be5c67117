"""Deletion files against the JVM's own Roaring bitmaps, Arrow's writer, and odd bytes."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.operators import positional as P
from cairn.sources import deletion_files as X
from cairn.sources.table import VersionedTable

SETS = {
    "none": [],
    "few": [1, 3, 5, 7, 9],
    "bits": list(range(0, 20_000, 2)),
    "runs": [*range(100, 9_000), *range(70_000, 200_000)],
    "many keys": [k * 65_536 + v for k in range(9) for v in (0, 5, 65_535)],
    "beyond 31 bits": [0, 2**31, 2**32 - 1],
}


def numbers(parts):
    return [int(x) for part in parts for x in part]


def by_jvm(spark, values, runs):
    made = spark._jvm.org.roaringbitmap.RoaringBitmap()
    ends = np.flatnonzero(np.diff(values) != 1).tolist() + [len(values) - 1] if values else []
    at = 0
    for end in ends:
        made.add(values[at], values[end] + 1)
        at = end + 1
    if runs:
        made.runOptimize()
    else:
        made.removeRunCompression()
    held = spark._jvm.java.io.ByteArrayOutputStream()
    made.serialize(spark._jvm.java.io.DataOutputStream(held))
    return bytes(held.toByteArray())


@pytest.mark.parametrize("runs", [False, True])
@pytest.mark.parametrize("name", [n for n in SETS if n != "bits"])
def test_bitmaps_of_the_jvm(spark, name, runs):
    assert numbers(X.roaring_decode(by_jvm(spark, SETS[name], runs))) == SETS[name]


@pytest.mark.parametrize("name", [n for n in SETS if n != "runs"])
def test_same_bytes_as_the_jvm(spark, name):
    assert X.roaring_encode(SETS[name][::-1] + SETS[name][:2]) == by_jvm(spark, SETS[name], False)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1)))
def test_round_trips(values):
    assert numbers(X.roaring_decode(X.roaring_encode(values))) == sorted(set(values))
    assert numbers(X.arrow_decode(X.arrow_encode(values))) == values


def test_arrow_batches_signed_and_null():
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, pa.schema([("row_id", pa.int32())])) as out:
        for values in ([4, None, 1], [], [-1]):
            out.write_batch(pa.record_batch([pa.array(values, pa.int32())], names=["row_id"]))
    assert numbers(X.arrow_decode(sink.getvalue().to_pybytes())) == [4, 1, 2**32 - 1]


@pytest.mark.parametrize("data", [b"", b"abc", b"abcdefgh", X.roaring_encode([1, 2])[:-1]])
def test_odd_bytes(data):
    with pytest.raises(ValueError, match="not a Roaring"):
        list(X.roaring_decode(data))
    with pytest.raises(ValueError, match="not an Arrow"):
        list(X.arrow_decode(data))


def test_paths():
    assert X.deletion_path("/t/", 3, 7, 12, "arrow") == "/t/_deletions/3-7-12.arrow"
    assert X.deletion_path("/t", 0, 1, -1, "bitmap") == f"/t/_deletions/0-1-{2**64 - 1}.bin"


@pytest.mark.parametrize("kind", ["arrow", "bitmap"])
def test_files_mask_a_table(spark, tmp_path, kind):
    gone = spark.createDataFrame([(0, o) for o in (1, 3, 5, 7, 9)] + [(2, 0)], f"{P.FRAG} int, {P.OFF} bigint")
    paths = X.write_deletions(gone, str(tmp_path), kind, 1)
    assert len(paths) == 2
    found = X.read_deletions(spark, paths)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, gone.collect()))
    table = VersionedTable(spark, str(tmp_path / "t")).create(spark.range(0, 45, 1, 1), 20)
    # a place that no row has, one twice, and one that is masked already change nothing
    odd = spark.createDataFrame([(0, 99), (9, 0), (0, 1)], f"{P.FRAG} int, {P.OFF} bigint")
    table.delete("id = 3").delete_at(found.unionByName(odd))
    left = [i for i in range(45) if i not in (1, 3, 5, 7, 9, 40)]
    assert sorted(r.id for r in table.read().collect()) == left and table.count_rows() == len(left)
    assert table.count_rows(2) == 44 and table.count_rows(1) == 45


def test_no_files_and_null_contents(spark):
    assert X.read_deletions(spark, []).count() == 0
    files = spark.createDataFrame([("x/1-1-1.bin", None), ("x/2-1-1.bin", bytearray(X.roaring_encode([])))], "path string, content binary")
    assert X.places(files).collect() == []
