"""Immutable snapshots of a table: fields, fragments and deletions as JSON, one file a version.

A snapshot file is created, never overwritten, through Hadoop's file system, so tables may live wherever Spark
reads and writes, and of two writers of a version one fails.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import types as T

FORMAT = 1


@dataclass(frozen=True)
class Fragment:
    """``groups``: the writes that hold its columns, first wins; ``rows`` as written, ``deleted`` of them masked."""

    frag: int
    groups: tuple[str, ...]
    rows: int
    deleted: int = 0

    @property
    def visible(self) -> int:
        return self.rows - self.deleted


@dataclass(frozen=True)
class Snapshot:
    """``fields`` are ``(id, name, Spark type as JSON)``; ``groups`` give each write's ``{field id: stored name}``."""

    version: int
    fields: tuple[tuple[int, str, str], ...]
    fragments: tuple[Fragment, ...]
    groups: dict[str, dict[str, str]] = field(default_factory=dict)
    deletions: str | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, T._parse_datatype_json_string(t), True) for _, n, t in self.fields])

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"format": FORMAT})

    @classmethod
    def from_json(cls, text: str) -> Snapshot:
        raw = json.loads(text)
        if raw.pop("format") != FORMAT:
            raise ValueError("snapshot of an unknown format")
        raw["fields"] = tuple(map(tuple, raw["fields"]))
        raw["fragments"] = tuple(Fragment(f["frag"], tuple(f["groups"]), f["rows"], f["deleted"]) for f in raw["fragments"])
        return cls(**raw)


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._dir = f"{path.rstrip('/')}/_versions"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._dir}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._jvm.org.apache.hadoop.fs.Path(self._dir)
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def load(self, version: int | None = None) -> Snapshot:
        there = self.versions()
        if not there:
            raise FileNotFoundError(f"no table at {self._dir}")
        if version is not None and version not in there:
            raise FileNotFoundError(f"no version {version}")
        for each in reversed(there) if version is None else (version,):
            if text := self._text(each):  # one that is still being written is empty
                return Snapshot.from_json(text)
        raise FileNotFoundError(f"no table at {self._dir}")

    def _text(self, version: int) -> str:
        stream = self._fs().open(self._path(f"{version}.json"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def save(self, snapshot: Snapshot) -> None:
        """Only one writer can create a version's file; the others fail."""
        made = self._path(f"{snapshot.version}.json")
        try:
            stream = self._fs().create(made, False)
        except Py4JJavaError as e:
            raise FileExistsError(f"version {snapshot.version} is there already") from e
        stream.write(bytearray(snapshot.to_json().encode()))
        stream.close()
