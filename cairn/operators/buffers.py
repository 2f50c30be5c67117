"""Pages as bytes: fixed-width values one after another or row by row, bitmaps, and compressed pages.

A page is the part of a column, or of some, in one fragment, ``(__frag, page)``; numbers are stored lowest byte first. Pages
are made and read with Arrow batches on the executors, a page in one row, which bounds it by what a row can hold. Where a
value is null belongs in a bitmap beside the page, so a null among the values is an error, as are bytes left over.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.positional import FRAG, OFF

#: Stored types and the Spark types they are read as: unsigned ones widen, half floats become floats.
KINDS = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint",
    "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double",
}
CODECS = ("zstd", "lz4")
#: A compressed page begins with its plain size in so many bytes (a fixed value), and Spark holds no larger value than this.
PREFIX, LARGEST = 8, (1 << 31) - 1
BATCH = 1 << 16


def _layout(types: dict[str, str]) -> np.dtype:
    """One row's bytes, without gaps. ``float32[3]`` is a list of three."""
    fields = []
    for name, kind in types.items():
        base, _, size = kind.partition("[")
        if base not in KINDS:
            raise ValueError(f"{kind}: no fixed-width type")
        fields.append((name, np.dtype(base).newbyteorder("<"), (int(size[:-1]),)) if size else (name, np.dtype(base).newbyteorder("<")))
    return np.dtype(fields)


def _spark_type(kind: str) -> str:
    base, _, size = kind.partition("[")
    return f"array<{KINDS[base]}>" if size else KINDS[base]


def _as_read(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Values as numbers of the type that they are read as; numpy has no type for 64-bit unsigned decimals."""
    if pa.types.is_decimal(kind):
        return pa.array([int(v) for v in values], pa.int64() if values.dtype.kind == "i" else pa.uint64()).cast(kind)
    return pa.array(values.astype(kind.to_pandas_dtype()), kind)


def _stored(column: pa.Array, name: str, kind: str, stored: np.dtype) -> np.ndarray:
    """Values as they are stored, none of them null; one that the type can't hold is an error."""
    values = np.array([int(v) for v in column.to_pylist()], np.uint64) if pa.types.is_decimal(column.type) else column.to_numpy(zero_copy_only=False)
    if stored.kind in "iu" and len(values) and (int(values.min()) < np.iinfo(stored).min or int(values.max()) > np.iinfo(stored).max):
        raise ValueError(f"{name} holds values beyond {kind}")
    return values.astype(stored)


def fits(types: dict[str, str]) -> Column:
    """Whether `fixed_pack` takes a row: no value is null, and lists are of their size, without null items."""
    each = [F.col(name).isNotNull() for name in types]
    for name, kind in types.items():
        if size := kind.partition("[")[2]:
            each += [F.size(name) == int(size[:-1]), F.forall(name, lambda x: x.isNotNull())]
    return F.coalesce(reduce(and_, each), F.lit(False))


def fixed_pack(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """``(__frag, page)``: rows of these columns in order, as a packed struct; of one column it is a flat page."""
    layout = _layout(types)

    def pack(key, rows):
        rows = rows.sort_by(OFF)
        out = np.zeros(rows.num_rows, layout)
        for name, kind in types.items():
            column = rows.column(name).combine_chunks()
            if isinstance(column, pa.ChunkedArray):  # an empty table's
                column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
            if column.null_count:
                raise ValueError(f"{name} holds nulls")
            if "[" in kind:
                flat, size = column.flatten(), layout[name].shape[0]
                if flat.null_count or any(n != size for n in column.value_lengths().to_numpy()):
                    raise ValueError(f"{name} isn't lists of {size} values")
                column, shape = flat, (-1, size)
            else:
                shape = (-1,)
            out[name] = _stored(column, name, kind, layout[name].base).reshape(shape)
        return pa.table({FRAG: pa.array([key[0].as_py()], pa.int32()), "page": pa.array([out.tobytes()], pa.binary())})

    return df.select(F.col(FRAG).cast("int").alias(FRAG), OFF, *types).groupBy(FRAG).applyInArrow(pack, f"{FRAG} int, page binary")


def fixed_unpack(pages: DataFrame, types: dict[str, str]) -> DataFrame:
    """``(__frag, __off, ...)``: the rows that `fixed_pack` packed."""
    layout, schema = _layout(types), ", ".join(f"`{n}` {_spark_type(k)}" for n, k in types.items())

    def unpack(batches):
        for batch in batches:
            for frag, page in zip(batch.column(0), batch.column(1), strict=True):
                data = page.as_buffer()
                if data is None or data.size % layout.itemsize:
                    raise ValueError(f"a page isn't rows of {layout.itemsize} bytes")
                rows = np.frombuffer(data, layout)
                for i in range(0, len(rows), BATCH):
                    part, out = rows[i : i + BATCH], []
                    for name, kind in types.items():
                        own = _arrow_type(KINDS[kind.partition("[")[0]])
                        values = _as_read(np.ascontiguousarray(part[name]).reshape(-1), own)
                        shape = layout[name].shape
                        out.append(pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * shape[0], values) if shape else values)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), frag.as_py(), np.int32)), pa.array(np.arange(i, i + len(part))), *out], [FRAG, OFF, *types])

    return pages.select(F.col(FRAG).cast("int"), "page").mapInArrow(unpack, f"{FRAG} int, {OFF} bigint, {schema}")


def _arrow_type(name: str) -> pa.DataType:
    plain = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    return plain.get(name) or pa.decimal128(20, 0)


def bits_pack(df: DataFrame, column: str) -> DataFrame:
    """``(__frag, n, page)``: a bitmap of booleans, the first in the lowest bit; a null is no set bit."""

    def pack(key, rows):
        held = rows.sort_by(OFF).column(column).fill_null(False).to_numpy().astype(np.uint8)
        page = np.packbits(held, bitorder="little").tobytes()
        return pa.table({FRAG: pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(held)], pa.int64()), "page": pa.array([page], pa.binary())})

    return df.select(F.col(FRAG).cast("int").alias(FRAG), OFF, column).groupBy(FRAG).applyInArrow(pack, f"{FRAG} int, n bigint, page binary")


def bits_unpack(pages: DataFrame) -> DataFrame:
    """``(__frag, __off, value)`` of a bitmap's first ``n`` bits."""

    def unpack(batches):
        for batch in batches:
            for frag, n, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if page is None or 8 * len(page) < n:
                    raise ValueError(f"a bitmap holds fewer than {n} bits")
                bits = np.unpackbits(np.frombuffer(page, np.uint8), count=n, bitorder="little").astype(bool)
                for i in range(0, n, BATCH):
                    part = bits[i : i + BATCH]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), frag, np.int32)), pa.array(np.arange(i, i + len(part))), pa.array(part)], [FRAG, OFF, "value"])

    return pages.select(F.col(FRAG).cast("int"), F.col("n").cast("bigint"), "page").mapInArrow(unpack, f"{FRAG} int, {OFF} bigint, value boolean")


def nullable_pack(df: DataFrame, column: str, kind: str) -> DataFrame:
    """``(__frag, n, bits, page)``: a bitmap of which values are there, and those without gaps."""
    stored = _layout({column: kind})[column]

    def pack(key, rows):
        held = pa.concat_arrays(rows.sort_by(OFF).column(column).chunks)
        bits = np.packbits(held.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), bitorder="little").tobytes()
        page = _stored(held.drop_null(), column, kind, stored).tobytes()
        columns = {FRAG: pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(held)], pa.int64()), "bits": pa.array([bits], pa.binary())}
        return pa.table(columns | {"page": pa.array([page], pa.binary())})

    if stored.subdtype:
        raise ValueError(f"{kind}: no flat type")
    return df.select(F.col(FRAG).cast("int").alias(FRAG), OFF, column).groupBy(FRAG).applyInArrow(pack, f"{FRAG} int, n bigint, bits binary, page binary")


def nullable_unpack(pages: DataFrame, kind: str) -> DataFrame:
    """``(__frag, __off, value)``: values back among the nulls; a page must hold as many as its bitmap says."""
    stored, own = _layout({"value": kind})["value"], _arrow_type(KINDS[kind])

    def unpack(batches):
        for batch in batches:
            for frag, n, bits, page in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bits is None or page is None or 8 * len(bits) < n or len(page) % stored.itemsize:
                    raise ValueError(f"no page of {n} values and nulls")
                there, values = np.unpackbits(np.frombuffer(bits, np.uint8), count=n, bitorder="little").astype(bool), np.frombuffer(page, stored)
                if there.sum() != len(values):
                    raise ValueError(f"a page holds {len(values)} values of {there.sum()}")
                spread = np.zeros(n, stored)
                spread[there] = values
                for i in range(0, n, BATCH):
                    part = _as_read(spread[i : i + BATCH], own)
                    part = pc.if_else(pa.array(there[i : i + BATCH]), part, pa.scalar(None, own))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), frag, np.int32)), pa.array(np.arange(i, i + len(part))), part], [FRAG, OFF, "value"])

    return pages.select(F.col(FRAG).cast("int"), F.col("n").cast("bigint"), "bits", "page").mapInArrow(unpack, f"{FRAG} int, {OFF} bigint, value {KINDS[kind]}")


def compressed(data: bytes, codec: str) -> bytes:
    """The plain size, lowest byte first, and then one frame of the codec."""
    return len(data).to_bytes(PREFIX, "little") + pa.Codec(codec).compress(data, asbytes=True)


def plain(data: bytes, codec: str) -> bytes:
    """What `compressed` compressed; ValueError if the bytes aren't that."""
    size = int.from_bytes(data[:PREFIX], "little")
    if len(data) < PREFIX or size > LARGEST:
        raise ValueError("a compressed page begins with its size")
    try:
        # as a stream: asked for more bytes than a frame holds, the block call makes the rest up
        out = pa.CompressedInputStream(pa.BufferReader(data[PREFIX:]), codec).read(size + 1)
    except OSError as e:
        raise ValueError(f"not a {codec} page: {e}") from e
    if len(out) != size:
        raise ValueError(f"a page doesn't hold {size} bytes")
    return out


def _pages(df: DataFrame, column: str, codec: str, change) -> DataFrame:
    if codec not in CODECS:
        raise ValueError(f"{codec}: no codec of {CODECS}")
    at = df.columns.index(column)

    def changed(batches):
        for batch in batches:
            made = pa.array([None if v is None else change(v, codec) for v in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.withColumn(column, F.col(column).cast("binary")).mapInArrow(changed, df.withColumn(column, F.col(column).cast("binary")).schema)


def compress(df: DataFrame, codec: str, column: str = "page") -> DataFrame:
    """A column's values compressed, each by itself; nulls stay and other columns pass through."""
    return _pages(df, column, codec, compressed)


def decompress(df: DataFrame, codec: str, column: str = "page") -> DataFrame:
    return _pages(df, column, codec, plain)
