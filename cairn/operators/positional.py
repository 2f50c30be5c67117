"""Row positions as data: fragments, deletion masks, row ids, ordinals, head, take and ranges.

Rows carry ``__frag`` and ``__off``, their fragment and their place in it. Ordinals of visible rows are
the place in the fragment plus the visible rows of earlier fragments, so nothing is ever ordered across
fragments; only the tiny per-fragment table is summed up in order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAG, OFF = "__frag", "__off"
#: Low bits of a row id that hold the place in the fragment.
LOCAL_BITS = 32


def read_positions(spark: SparkSession, file: str, rows_per_fragment: int) -> DataFrame:
    """One Parquet file, or a folder's files in the order of their names, partition by partition, as logical fragments of so
    many rows. The row index must be taken at the scan; it begins anew in each file, so rows of earlier files are counted first."""
    at, path = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    df = spark.read.parquet(file)
    rows = df.select("*", at.alias("__at"))
    if len(df.inputFiles()) > 1:
        ends = df.select(path.alias("__file"), at.alias("__at")).groupBy("__file").agg((F.max("__at") + 1).alias("__n"))
        # a row a file; the scan names files as URLs, which are in another order where they escape a character
        plain = F.url_decode(F.replace("__file", F.lit("+"), F.lit("%2B")))
        # as DuckDB lists them, in which the SQL is stated: folders above the last go by their paths, the last by its name
        # alone, but the files of the first folders, as many as make two files, together by their paths
        above, last = (F.regexp_extract(plain, "(?s)^(.*/)([^/]*)/[^/]*$", i) for i in (1, 2))
        ends = ends.withColumn("__first", F.rank().over(Window.orderBy(above, last)) <= 2)
        order = Window.orderBy(F.desc("__first"), F.when(F.col("__first"), plain), above, last, plain)
        before = F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        starts = ends.select("__file", F.coalesce(before, F.lit(0)).alias("__before"))
        rows = df.select("*", path.alias("__file"), at.alias("__at")).join(F.broadcast(starts), "__file").withColumn("__at", F.col("__at") + F.col("__before"))
    return rows.select(*df.columns, F.expr(f"__at div {rows_per_fragment}").alias(FRAG), (F.col("__at") % rows_per_fragment).alias(OFF))


def row_range(spark: SparkSession, file: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset + limit - 1`` of one file, whatever was deleted from it. A negative offset is 0,
    a negative limit none, and beyond the end there are no rows. The filter is pushed to the scan."""
    offset, limit = max(0, offset), max(0, limit)
    df, at = spark.read.parquet(file), F.col("_metadata.row_index")
    return df.filter((at >= offset) & (at < offset + limit)).select(*df.columns)


def project(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    """Known columns in the table's own order, each once; positions stay. None or nothing asked for is all."""
    if not columns:
        return df
    return df.select(*[c for c in df.columns if c in set(columns) or c in (FRAG, OFF)])


def without_positions(df: DataFrame) -> DataFrame:
    return df.drop(FRAG, OFF)


def apply_deletions(df: DataFrame, deletions: DataFrame) -> DataFrame:
    """Rows whose position isn't in ``(__frag, __off)``; positions that no row has don't matter."""
    return df.join(deletions.select(FRAG, OFF), [FRAG, OFF], "left_anti")


def local(deleted: bool = True) -> Column:
    """A visible row's place among its fragment's visible rows; without deletions that is its place."""
    return F.row_number().over(Window.partitionBy(FRAG).orderBy(OFF)).cast("bigint") - 1 if deleted else F.col(OFF).cast("bigint")


def row_id(deleted: bool = True) -> Column:
    """``_rowid``: the fragment in the high bits, and the place among its *visible* rows in the low ones."""
    return F.col(FRAG).cast("bigint") * F.lit(1 << LOCAL_BITS) + local(deleted)


def visible_counts(df: DataFrame) -> DataFrame:
    """``(__frag, visible, before)``: visible rows of each fragment, and those of all fragments before it."""
    counts = df.groupBy(FRAG).agg(F.count(F.lit(1)).alias("visible"))
    # a row a fragment: small enough to be put in order in one place
    before = F.sum("visible").over(Window.orderBy(FRAG).rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("before", F.coalesce(before, F.lit(0)))


def with_ordinals(df: DataFrame, counts: DataFrame, deleted: bool = True) -> DataFrame:
    """Add ``__ord``, the row's place among all visible rows."""
    return df.withColumn("__local", local(deleted)).join(counts.select(FRAG, "before"), FRAG).withColumn("__ord", F.col("before") + F.col("__local")).drop("before", "__local")


def head(df: DataFrame, counts: DataFrame, n: int, deleted: bool = True) -> DataFrame:
    """The first n visible rows in fragment order; none if n isn't positive. Fragments that lie beyond are not read on."""
    needed = counts.filter(F.col("before") < max(0, n))
    return with_ordinals(df, needed, deleted).filter(F.col("__ord") < max(0, n))


def take(df: DataFrame, counts: DataFrame, indices: Sequence[int], total: int, deleted: bool = True) -> DataFrame:
    """Visible rows by ordinal, repeats kept; ``slot`` is the place in the request. Raises IndexError before
    any row is read if an index is negative or not below ``total``. The request comes from the caller and is small."""
    bad = [i for i in indices if not 0 <= i < total]
    if bad:
        raise IndexError(f"row {bad[0]} of {total}")
    spark = df.sparkSession
    if not indices:
        return with_ordinals(df, counts, deleted).filter(F.lit(False)).withColumn("slot", F.lit(0).cast("bigint"))
    asked = spark.createDataFrame([(s, i) for s, i in enumerate(indices)], "slot bigint, __ord bigint")
    return with_ordinals(df, counts, deleted).join(F.broadcast(asked), "__ord")


def merge_columns(parts: Sequence[DataFrame]) -> DataFrame:
    """Column files of the same rows, put together by position; of a repeated name the first file's stays. A row that a
    later file lacks is an error (what it has beyond the first one's rows, a table's write has ruled out)."""
    out = parts[0]
    for part in parts[1:]:
        own = part.select(FRAG, OFF, F.lit(True).alias("__there"), *[c for c in part.columns if c not in out.columns])
        names = [c for c in own.columns if c not in (FRAG, OFF, "__there")]
        joined = out.join(own, [FRAG, OFF], "left")
        there = F.when(F.col("__there"), F.col(OFF)).otherwise(F.raise_error(F.lit("a column file lacks a row")).cast("bigint"))
        out = joined.select(*[F.col(f"`{c}`") for c in out.columns if c != OFF], there.alias(OFF), *[F.col(f"`{c}`") for c in names])
    return out


def align(df: DataFrame, schema) -> DataFrame:
    """Columns in the schema's order; one that is missing is null."""
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], *[c for c in (FRAG, OFF) if c in have])
