"""Shared plumbing of the operators: reading tables, Arrow row maps, and cutting lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A kernel maps one Arrow batch's input columns to its output columns, row by row.
Kernel = Callable[[Sequence[pa.Array]], Sequence[pa.Array]]
#: Bytes of a batch that a kernel is given, and sends back, at once (one row at least).
PART_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores put before it as keep it apart from the frame's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def map_columns(
    df: DataFrame,
    inputs: Sequence[str],
    outputs: str | T.StructType,
    make_kernel: Callable[[], Kernel],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns computed by an Arrow kernel; the rest of each row passes through untouched.

    ``keep`` names the columns that pass through (all by default). An output column replaces a
    kept column of the same name, whatever its case, as ``withColumn`` does. ``make_kernel`` runs once a task.
    Kernels get batches in parts of about `PART_BYTES`, so what worker and JVM hold of results is bounded by that
    and by the longest row, not by ten thousand rows of long texts.
    """
    added = T.StructType.fromDDL(outputs) if isinstance(outputs, str) else outputs
    taken = {f.name.lower() for f in added.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken and (keep is None or f.name in keep)]
    names, n_kept = [f.name for f in [*kept, *added.fields]], len(kept)
    # an input that passes through is sent once
    place = {f.name: i for i, f in enumerate(kept)}
    extra = [c for c in dict.fromkeys(inputs) if c not in place]
    place |= {c: n_kept + i for i, c in enumerate(extra)}
    sent = df.select(*[F.col(f"`{f.name}`") for f in kept], *[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            rows = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
            for at in range(0, max(1, batch.num_rows), rows):
                columns = batch.slice(at, rows).columns
                made = kernel([columns[place[c]] for c in inputs])
                yield pa.RecordBatch.from_arrays([*columns[:n_kept], *made], names=names)

    return sent.mapInArrow(run, T.StructType([*kept, *added.fields]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``, or where the session names
    none, one in its warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")


class _Scratch:
    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table that outlives the block."""
        out = materialise(df, name)
        self.kept.add(self.made[-1])
        return out


_scratch: ContextVar[_Scratch | None] = ContextVar("scratch", default=None)


def drop_table(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(where) if at_exit else fs.delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[_Scratch]:
    """Tables written within go when the block ends, but for those that are kept; they go with an outer block or
    with the session."""
    own, outer = _Scratch(spark), _scratch.get()
    token = _scratch.set(own)
    try:
        yield own
    finally:
        _scratch.reset(token)
        for path in own.made:
            if path not in own.kept:
                drop_table(spark, path)
            elif outer is not None:
                outer.made.append(path)
            else:
                drop_table(spark, path, at_exit=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _scratch.get()) is not None:
        own.made.append(path)
    else:
        drop_table(spark, path, at_exit=True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
