"""Versions, deletions, row ids, schema evolution and positional reads, with the fixtures' numbers."""

import dataclasses

import pytest

from cairn.operators import positional as P
from cairn.sources.snapshots import Snapshot
from cairn.sources.table import VersionedTable


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def frame(spark, n, start=0):
    return spark.range(start, start + n, 1, 3).selectExpr("cast(id AS int) AS id", "concat('n', id) AS name", "id * 1.5D AS score")


@pytest.fixture()
def counted(spark, tmp_path):
    """100 rows; then without id < 30; then 50 more."""
    return VersionedTable(spark, str(tmp_path / "t")).create(frame(spark, 100), 40).delete("id < 30").append(frame(spark, 50, 100), 40)


def test_counts_need_no_data(spark, counted):
    assert [counted.count_rows(v) for v in (1, 2, 3, None)] == [100, 70, 120, 120]
    assert [counted.read(version=v).count() for v in (1, 2, 3)] == [100, 70, 120]
    assert counted.versions() == [1, 2, 3]


def test_take(counted):
    assert ids(counted.take([0, 50, 99], version=1)) == [0, 50, 99]
    assert ids(counted.take([0, 34, 69], version=2)) == [30, 64, 99]
    assert ids(counted.take([0, 69, 70, 119])) == [30, 99, 100, 149]
    assert ids(counted.take([5, 5, 0, 119, 5])) == [35, 35, 30, 149, 35]
    empty = counted.take([])
    assert empty.count() == 0 and empty.columns == ["id", "name", "score"]
    assert counted.take(None).count() == 0
    for bad in ([120], [-1], [0, 500]):
        with pytest.raises(IndexError):
            counted.take(bad)
    assert counted.take([3, 1], ["score", "id", "nope"]).columns == ["id", "score"]


def test_head(counted):
    rows = ids(counted.head(80))
    assert len(rows) == 80 and (rows[0], rows[69], rows[70], rows[79]) == (30, 99, 100, 109)
    assert len(ids(counted.head(100, version=2))) == 70
    for n in (0, -3):
        none = counted.head(n)
        assert none.count() == 0 and len(none.columns) == 3
    assert ids(counted.head(10**6)) == ids(counted.take(range(120)))


def test_versions_and_deletions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t")).create(frame(spark, 20)).delete("id IN (1, 3, 5, 7, 9)").append(frame(spark, 10, 20))
    assert [t.read(version=v).count() for v in (1, 2, 3)] == [20, 15, 25]
    rows = ids(t.head(100))
    assert rows[:5] == [0, 2, 4, 6, 8] and (rows[15], rows[24]) == (20, 29)
    assert sorted(ids(t.read(["id"], version=2))) == [0, 2, 4, 6, 8, *range(10, 20)]
    with pytest.raises(FileNotFoundError):
        t.read(version=9)


def test_row_ids(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t")).create(frame(spark, 2000), 1000)
    first = {r.id: r._rowid for r in t.read(with_row_id=True).collect()}
    assert all(first[i] == i and first[1000 + i] == 2**32 + i for i in range(1000))
    t.delete("id >= 100 AND id < 200")
    after = {r.id: r._rowid for r in t.read(["id"], with_row_id=True).collect()}
    assert after[200] == 100 and after[99] == 99 and after[1500] == 2**32 + 500
    old = t.read(["name"], with_row_id=True, version=1)
    assert old.columns == ["name", "_rowid"] and old.count() == 2000
    none = t.delete("id >= 0").read(with_row_id=True)
    assert none.count() == 0 and none.columns[-1] == "_rowid" and t.count_rows() == 0


def test_empty_table(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t")).create(frame(spark, 10).limit(0))
    assert t.count_rows() == 0 and t.read(["name"]).columns == ["name"] and t.read().count() == 0
    assert t.head(10).count() == 0 and t.take([]).count() == 0
    assert t.read(with_row_id=True).columns == ["id", "name", "score", "_rowid"]
    with pytest.raises(IndexError):
        t.take([0])
    assert t.append(frame(spark, 3)).count_rows() == 3


def test_schema_evolution(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t")).create(frame(spark, 20).drop("score"), 7)
    t.add_column("score", "cast(id AS float) * 1.5").drop_column("name")
    assert [t.read(version=v).columns for v in (1, 2, 3)] == [["id", "name"], ["id", "name", "score"], ["id", "score"]]
    rows = {r.id: r.score for r in t.read().collect()}
    assert (rows[10], rows[19]) == (15.0, 28.5)
    t.append(spark.createDataFrame([(99,)], "id int"))  # null-filled
    assert t.take([20]).collect()[0].score is None
    t.add_column("name", "id + 1").rename_column("score", "points")  # the old name's data stays away
    assert {r.id: (r.points, r.name) for r in t.read().collect()}[10] == (15.0, 11)
    assert ids(t.delete("id < 3").take([0, 1])) == [3, 4]


def test_reads_prune_columns_and_fragments(counted):
    plan = counted.read(["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<f0:int,__off:bigint>" in plan and "CartesianProduct" not in plan
    few = counted.take([119], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__frag" in few and "__frag" in few


def test_snapshot_json(counted):
    snap = counted.snapshot()
    assert Snapshot.from_json(snap.to_json()) == snap
    with pytest.raises(FileExistsError):
        counted.store.save(snap)


def test_row_ranges(spark, tmp_path):
    frame(spark, 100).coalesce(1).write.parquet(str(tmp_path / "r"))
    file = next(str(p) for p in (tmp_path / "r").iterdir() if p.suffix == ".parquet")
    read = lambda o, n: ids(P.row_range(spark, file, o, n))
    assert read(10, 20) == list(range(10, 30)) and read(90, 20) == list(range(90, 100)) and read(100, 10) == []
    assert read(-5, 3) == [0, 1, 2] and read(3, -1) == []


def test_head_and_take_agree(spark, counted):
    total = counted.count_rows()
    assert ids(counted.take(range(total))) == ids(counted.head(total))
    assert sorted(ids(counted.read(["id"]))) == sorted(ids(counted.head(total, ["id"])))


def test_rows_of_an_aggregate_under_aqe_all_stay(spark, tmp_path):
    """Number and order of partitions change between a plan's runs; rows are written once and numbered from files."""
    big = spark.range(0, 60_000, 1, 8).selectExpr("id % 20000 AS k", "id AS v").groupBy("k").agg({"v": "max"}).withColumnRenamed("max(v)", "v")
    t = VersionedTable(spark, f"{tmp_path}/t").create(big, 700)
    t.append(big, 900)
    rows = t.read(with_row_id=True)
    assert t.count_rows() == rows.count() == rows.select("_rowid").distinct().count() == 40_000
    assert rows.filter("_rowid IS NULL").count() == 0 and rows.groupBy("k", "v").count().filter("count <> 2").count() == 0


def test_column_files_of_other_rows_are_refused(spark, tmp_path):
    left = spark.createDataFrame([(0, i, i) for i in range(5)], "__frag int, __off bigint, a int")
    right = left.filter("__off < 4").select("__frag", "__off", (left["a"] * 2).alias("b"))
    with pytest.raises(Exception, match="lacks a row"):
        P.merge_columns([left, right]).collect()
    t = VersionedTable(spark, f"{tmp_path}/t").create(spark.range(10).toDF("a"), 4)
    with pytest.raises(ValueError, match="rows written"):
        t._check(next(iter(t.snapshot().groups)), {0: 4, 1: 4, 2: 3})


def test_one_of_two_writers_fails(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t").create(spark.range(10).toDF("a"))
    snap = t.snapshot()
    t.delete("a = 1")
    with pytest.raises(FileExistsError):
        t.store.save(dataclasses.replace(snap, version=2))
    assert t.count_rows() == 9


def test_one_fragment(counted):
    assert ids(counted.read_fragment(0, version=1)) == list(range(40)) and ids(counted.read_fragment(0)) == list(range(30, 40))
    assert counted.read_fragment(2, ["score"], 1).columns == ["score"] and counted.read_fragment(3).count() == 40
    with pytest.raises(KeyError):
        counted.read_fragment(3, version=2)
