"""Versioned tables of Parquet fragments: time travel, deletion masks, schema evolution, positional reads."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators import positional as P
from cairn.sources.shared import drop_folder
from cairn.sources.snapshots import Fragment, Snapshot, SnapshotStore


class VersionedTable:
    """Reads never change a table; each write makes a new version, and older ones stay readable.

    Columns are matched by field id, so a dropped name can come back as another column.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), SnapshotStore(spark, path)

    # reading

    def versions(self) -> list[int]:
        return self.store.versions()

    def snapshot(self, version: int | None = None) -> Snapshot:
        return self.store.load(version)

    def _scan(self, snap: Snapshot, columns: Sequence[str] | None, frags: set[int] | None = None) -> DataFrame:
        """Visible rows with positions: one scan for each set of writes that fragments share."""
        wanted = [f for f in snap.fields if not columns or f[1] in set(columns)]
        schema = T.StructType([f for f in snap.schema.fields if f.name in {w[1] for w in wanted}])
        layouts: dict[tuple[str, ...], list[int]] = {}
        for f in snap.fragments:
            if frags is None or f.frag in frags:
                layouts.setdefault(f.groups, []).append(f.frag)
        parts = []
        for groups, own in layouts.items():
            files, found = [], set()
            for g in groups:
                held = [(i, n) for i, n, _ in wanted if str(i) in snap.groups[g] and i not in found]
                if held or not files and g == groups[-1]:
                    found |= {i for i, _ in held}
                    df = self.spark.read.parquet(f"{self.path}/data/{g}").filter(F.col(P.FRAG).isin(own))
                    files.append(df.select(*[F.col(f"`{snap.groups[g][str(i)]}`").alias(n) for i, n in held], P.FRAG, P.OFF))
            parts.append(P.align(P.merge_columns(files), schema))
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(P.FRAG, T.IntegerType()), T.StructField(P.OFF, T.LongType())]))
        rows = reduce(DataFrame.unionByName, parts)
        masked = [f.frag for f in snap.fragments if f.deleted and (frags is None or f.frag in frags)]
        if masked:
            rows = P.apply_deletions(rows, self.spark.read.parquet(f"{self.path}/deletions/{snap.deletions}").filter(F.col(P.FRAG).isin(masked)))
        return rows

    def _deleted(self, snap: Snapshot) -> bool:
        return any(f.deleted for f in snap.fragments)

    def _counts(self, snap: Snapshot, frags: set[int] | None = None) -> DataFrame:
        visible = [f.visible for f in snap.fragments]
        rows = [(f.frag, v, b) for f, v, b in zip(snap.fragments, visible, [0, *accumulate(visible)], strict=False) if frags is None or f.frag in frags]
        return F.broadcast(self.spark.createDataFrame(rows, f"{P.FRAG} int, visible bigint, before bigint"))

    def _needed(self, snap: Snapshot, ordinals: Sequence[int]) -> set[int]:
        """Fragments that hold these visible rows, from the snapshot alone."""
        ends = list(accumulate(f.visible for f in snap.fragments))
        out, at = set(), 0
        for o in sorted(ordinals):
            while ends[at] <= o:
                at += 1
            out.add(snap.fragments[at].frag)
        return out

    def read(self, columns: Sequence[str] | None = None, with_row_id: bool = False, version: int | None = None) -> DataFrame:
        snap = self.snapshot(version)
        rows = self._scan(snap, columns)
        if with_row_id:
            rows = rows.withColumn("_rowid", P.row_id(self._deleted(snap)))
        return P.without_positions(rows)

    def read_fragment(self, frag: int, columns: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
        """One fragment's visible rows; KeyError if the version has no such fragment. No other fragment's files are read."""
        snap = self.snapshot(version)
        if frag not in {f.frag for f in snap.fragments}:
            raise KeyError(f"no fragment {frag}")
        return P.without_positions(self._scan(snap, columns, {frag}))

    def count_rows(self, version: int | None = None) -> int:
        """From the snapshot alone; no data is read."""
        return sum(f.visible for f in self.snapshot(version).fragments)

    def head(self, n: int, columns: Sequence[str] | None = None, version: int | None = None, ordinal: str | None = None) -> DataFrame:
        """The first n visible rows; ``ordinal`` names a column that takes their places."""
        snap = self.snapshot(version)
        n = max(0, min(n, sum(f.visible for f in snap.fragments)))
        frags = {f.frag for f, before in zip(snap.fragments, [0, *accumulate(f.visible for f in snap.fragments)], strict=False) if before < n}
        rows = P.head(self._scan(snap, columns, frags), self._counts(snap, frags), n, self._deleted(snap))
        rows = rows.orderBy("__ord")
        return P.without_positions(rows.withColumnRenamed("__ord", ordinal) if ordinal else rows.drop("__ord"))

    def take(self, indices: Sequence[int], columns: Sequence[str] | None = None, version: int | None = None, slot: str | None = None) -> DataFrame:
        """Visible rows by ordinal, in the order asked for; ``slot`` names a column that takes the place in the request."""
        snap, indices = self.snapshot(version), list(indices or [])
        total = sum(f.visible for f in snap.fragments)
        if any(not 0 <= i < total for i in indices):
            raise IndexError(f"a row index is not within the table's {total} rows")
        frags = self._needed(snap, indices)
        rows = P.take(self._scan(snap, columns, frags), self._counts(snap, frags), indices, total, self._deleted(snap))
        rows = rows.orderBy("slot").drop("__ord")
        return P.without_positions(rows.withColumnRenamed("slot", slot) if slot else rows.drop("slot"))

    # writing

    def _write(self, df: DataFrame, fields: Sequence[tuple[int, str, str]], group: str) -> dict[str, str]:
        names = {str(i): f"f{i}" for i, _, _ in fields}
        df.select(*[F.col(f"`{n}`").alias(f"f{i}") for i, n, _ in fields], P.FRAG, P.OFF).write.partitionBy(P.FRAG).parquet(f"{self.path}/data/{group}")
        return names

    def _staged(self, df: DataFrame, fields: Sequence[tuple[int, str, str]], rows_per_fragment: int, first: int) -> tuple[str, DataFrame, int]:
        """The frame's rows written once, and read from there with positions in its own order: a row's place is the
        rows of earlier files and its index in its file. So numbers never depend on how a plan runs twice."""
        path = f"{self.path}/_staged/{uuid.uuid4().hex}"
        df.select(*[F.col(f"`{n}`").alias(f"f{i}") for i, n, _ in fields]).write.parquet(path)
        rows = self.spark.read.schema(T.StructType([T.StructField(f"f{i}", T._parse_datatype_json_string(t)) for i, _, t in fields])).parquet(path)
        located = rows.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
        # a row a file: put in order in one place
        sizes = located.groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = F.col("start") + F.col("__at")
        position = {P.FRAG: F.expr(f"cast((start + __at) div {rows_per_fragment} as int) + {first}"), P.OFF: at % rows_per_fragment}
        numbered = located.join(sizes.select("__file", before.alias("start")), "__file").withColumns(position).drop("__file", "__at", "start", "n")
        return path, numbered, sizes.agg(F.sum("n")).first()[0] or 0

    def create(self, df: DataFrame, rows_per_fragment: int = 1_000_000) -> VersionedTable:
        return self._extend(df, rows_per_fragment, Snapshot(0, tuple((i, f.name, f.dataType.json()) for i, f in enumerate(df.schema.fields)), ()))

    def append(self, df: DataFrame, rows_per_fragment: int = 1_000_000) -> VersionedTable:
        return self._extend(df, rows_per_fragment, self.snapshot())

    def _extend(self, df: DataFrame, rows_per_fragment: int, snap: Snapshot) -> VersionedTable:
        df = P.align(df, snap.schema)
        first = max((f.frag for f in snap.fragments), default=-1) + 1
        staged, numbered, total = self._staged(df, snap.fields, rows_per_fragment, first)
        sizes = [min(rows_per_fragment, total - i) for i in range(0, total, rows_per_fragment)]
        group = uuid.uuid4().hex
        if sizes:
            numbered.write.partitionBy(P.FRAG).parquet(f"{self.path}/data/{group}")
            self._check(group, {first + i: n for i, n in enumerate(sizes)})
        names = {str(i): f"f{i}" for i, _, _ in snap.fields} if sizes else {}
        drop_folder(self.spark, staged)
        added = tuple(Fragment(first + i, (group,), n) for i, n in enumerate(sizes))
        self.store.save(replace(snap, version=snap.version + 1, fragments=snap.fragments + added, groups=snap.groups | ({group: names} if sizes else {})))
        return self

    def _check(self, group: str, rows: dict[int, int]) -> None:
        """A write holds as many rows of each fragment as the snapshot will say; a row a fragment reaches the driver."""
        held = dict(self.spark.read.parquet(f"{self.path}/data/{group}").groupBy(P.FRAG).count().collect())
        if held != rows:
            wrong = sorted((f for f in held.keys() | rows.keys() if held.get(f) != rows.get(f)), key=str)
            raise ValueError(f"fragment {wrong[0]} has {held.get(wrong[0])} rows written of {rows.get(wrong[0])}")

    def delete(self, predicate: str) -> VersionedTable:
        """Mask the visible rows that a SQL predicate is true for."""
        snap = self.snapshot()
        return self._mask(snap, self._scan(snap, None).filter(predicate).select(P.FRAG, P.OFF))

    def delete_at(self, positions: DataFrame) -> VersionedTable:
        """Mask rows by ``(__frag, __off)``, as from deletion files; repeats, masked rows and places that no row has don't matter."""
        snap = self.snapshot()
        visible = self._scan(snap, [n for _, n, _ in snap.fields[:1]]).select(P.FRAG, P.OFF)
        return self._mask(snap, visible.join(positions.select(P.FRAG, P.OFF), [P.FRAG, P.OFF], "left_semi"))

    def _mask(self, snap: Snapshot, hit: DataFrame) -> VersionedTable:
        if snap.deletions:
            hit = hit.unionByName(self.spark.read.parquet(f"{self.path}/deletions/{snap.deletions}"))
        name = uuid.uuid4().hex
        hit.write.parquet(f"{self.path}/deletions/{name}")
        counts = dict(self.spark.read.parquet(f"{self.path}/deletions/{name}").groupBy(P.FRAG).count().collect())
        fragments = tuple(replace(f, deleted=counts.get(f.frag, 0)) for f in snap.fragments)
        self.store.save(replace(snap, version=snap.version + 1, fragments=fragments, deletions=name))
        return self

    def add_column(self, name: str, expression: str) -> VersionedTable:
        """A column computed from visible rows, in column files of its own; masked rows have none."""
        snap = self.snapshot()
        if name in {n for _, n, _ in snap.fields}:
            raise ValueError(f"there is a column {name}")
        made = self._scan(replace(snap, deletions=None, fragments=tuple(replace(f, deleted=0) for f in snap.fragments)), None).select(F.expr(expression).alias(name), P.FRAG, P.OFF)
        known = [int(i) for names in snap.groups.values() for i in names] + [i for i, _, _ in snap.fields]
        field, group = (max(known, default=-1) + 1, name, made.schema[name].dataType.json()), uuid.uuid4().hex
        names = self._write(made, [field], group) if snap.fragments else {}
        if names:
            self._check(group, {f.frag: f.rows for f in snap.fragments})
        fragments = tuple(replace(f, groups=(*f.groups, group)) for f in snap.fragments)
        self.store.save(replace(snap, version=snap.version + 1, fields=(*snap.fields, field), fragments=fragments, groups=snap.groups | ({group: names} if names else {})))
        return self

    def drop_column(self, name: str) -> VersionedTable:
        snap = self.snapshot()
        self.store.save(replace(snap, version=snap.version + 1, fields=tuple(f for f in snap.fields if f[1] != name)))
        return self

    def rename_column(self, name: str, new: str) -> VersionedTable:
        snap = self.snapshot()
        self.store.save(replace(snap, version=snap.version + 1, fields=tuple((i, new if n == name else n, t) for i, n, t in snap.fields)))
        return self
