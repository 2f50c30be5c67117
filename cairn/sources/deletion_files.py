"""Deletion files, one a fragment: places of masked rows as an Arrow file or as a Roaring bitmap.

A file is decoded from one row, by whichever executor reads it, so nothing but the names reaches the driver. That bounds a
file by what a row can hold, which is far beyond a fragment's places: 8 kB for 65,536 rows as a bitmap, four bytes a
masked row in Arrow. Places are unsigned 32-bit numbers. A file without places gives no rows; a null content
likewise; repeated places of an Arrow file stay repeated; bytes of neither format raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.positional import FRAG, OFF

#: Kinds of file and the endings of their names (fixed values).
ENDINGS = {"arrow": "arrow", "bitmap": "bin"}
NAME = r"([0-9]+)-[0-9]+-[0-9]+\.(arrow|bin)$"
#: The published Roaring format (fixed values): cookies without and with runs, the size from which a bitmap with runs has
#: offsets, the largest container of single numbers, and the bytes of a container of bits.
PLAIN, WITH_RUNS, OFFSETS_FROM, MOST_SINGLE, BITS_BYTES = 12346, 12347, 4, 4096, 8192
#: Rows of a batch handed back.
BATCH = 1 << 16


def deletion_path(root: str, frag: int, read_version: int, file_id: int, kind: str) -> str:
    """Where a fragment's deletion file lies; the id is written as an unsigned number."""
    return f"{root.rstrip('/')}/_deletions/{frag}-{read_version}-{file_id % (1 << 64)}.{ENDINGS[kind]}"


def roaring_decode(data: bytes) -> Iterator[np.ndarray]:
    """The numbers of a Roaring bitmap in order, one array a container."""
    try:
        yield from _containers(data)
    except (IndexError, ValueError) as e:
        raise ValueError(f"not a Roaring bitmap: {e}") from e


def _containers(data: bytes) -> Iterator[np.ndarray]:
    at = 4
    cookie = int(np.frombuffer(data, "<u4", 1)[0])
    if cookie == PLAIN:
        size, runs = int(np.frombuffer(data, "<u4", 1, at)[0]), None
        at += 4
    elif cookie & 0xFFFF == WITH_RUNS:
        size = (cookie >> 16) + 1
        runs = np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), bitorder="little")
        at += (size + 7) // 8
    else:
        raise ValueError(f"cookie {cookie}")
    heads = np.frombuffer(data, "<u2", 2 * size, at).reshape(size, 2).astype(np.int64)
    at += 4 * size + (4 * size if runs is None or size >= OFFSETS_FROM else 0)
    for i, (high, less) in enumerate(heads):
        count = int(less) + 1
        if runs is not None and runs[i]:
            n = int(np.frombuffer(data, "<u2", 1, at)[0])
            spans = np.frombuffer(data, "<u2", 2 * n, at + 2).reshape(n, 2).astype(np.int64)
            low = np.concatenate([np.arange(start, start + more + 1) for start, more in spans]) if n else np.empty(0, np.int64)
            at += 2 + 4 * n
        elif count <= MOST_SINGLE:
            low = np.frombuffer(data, "<u2", count, at).astype(np.int64)
            at += 2 * count
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, BITS_BYTES, at), bitorder="little"))
            at += BITS_BYTES
        if len(low) != count:
            raise ValueError(f"a container holds {len(low)} numbers of {count}")
        yield (high << 16) + low


def roaring_encode(numbers: np.ndarray) -> bytes:
    """A Roaring bitmap of numbers, without runs; order and repeats don't matter."""
    numbers = np.unique(np.asarray(numbers, dtype=np.int64))
    keys, starts = np.unique(numbers >> 16, return_index=True)
    bodies = []
    for low in np.split((numbers & 0xFFFF).astype("<u2"), starts[1:]) if len(keys) else []:
        if len(low) > MOST_SINGLE:
            bits = np.zeros(8 * BITS_BYTES, np.uint8)
            bits[low] = 1
            bodies.append((len(low), np.packbits(bits, bitorder="little").tobytes()))
        else:
            bodies.append((len(low), low.tobytes()))
    heads = np.array([[k, n - 1] for k, (n, _) in zip(keys, bodies, strict=True)], "<u2").tobytes()
    first = 8 + 8 * len(keys)
    offsets = first + np.cumsum([0, *(len(b) for _, b in bodies)])[:-1]
    return np.array([PLAIN, len(keys)], "<u4").tobytes() + heads + offsets.astype("<u4").tobytes() + b"".join(b for _, b in bodies)


def arrow_decode(data: bytes) -> Iterator[np.ndarray]:
    """The first column of an Arrow file, every batch of it; nulls are left out."""
    try:
        file = pa.ipc.open_file(pa.py_buffer(data))
    except pa.ArrowInvalid as e:
        raise ValueError(f"not an Arrow file: {e}") from e
    for i in range(file.num_record_batches):
        # a place beyond 31 bits is stored as a negative number
        yield file.get_batch(i).column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF


def arrow_encode(numbers: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array(np.asarray(numbers, np.int64).astype(np.uint32))], names=["row_id"])
    with pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


DECODERS = {"arrow": arrow_decode, "bin": roaring_decode}
ENCODERS = {"arrow": arrow_encode, "bitmap": roaring_encode}


def places(files: DataFrame) -> DataFrame:
    """``(__frag, __off)`` of the masked rows in files ``(path, content)``; a file's name says its fragment and kind."""
    named = files.select(F.regexp_extract("path", NAME, 1).cast("int").alias(FRAG), F.regexp_extract("path", NAME, 2).alias("ending"), "content")

    def decode(batches):
        for batch in batches:
            for frag, ending, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                if ending.as_py() not in DECODERS:
                    raise ValueError("a deletion file's name is <fragment>-<version>-<id>.arrow or .bin")
                for found in DECODERS[ending.as_py()](content.as_py()) if content.is_valid else ():
                    for i in range(0, len(found), BATCH):
                        off = pa.array(found[i : i + BATCH], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(off), frag.as_py(), np.int32)), off], [FRAG, OFF])

    return named.mapInArrow(decode, f"{FRAG} int, {OFF} bigint")


def read_deletions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(__frag, __off)`` of the rows that the named deletion files mask; no files, no rows."""
    if not paths:
        return spark.createDataFrame([], f"{FRAG} int, {OFF} bigint")
    return places(spark.read.format("binaryFile").load(list(paths)).select("path", "content"))


def write_deletions(positions: DataFrame, root: str, kind: str, read_version: int) -> list[str]:
    """A deletion file for each fragment of ``(__frag, __off)``, and their paths. Files are encoded on the executors and
    written from the driver, one at a time, through Hadoop's file system; a fragment's places must fit in a task."""
    spark = positions.sparkSession
    encode = ENCODERS[kind]

    def encoded(key, rows):
        content = encode(np.sort(rows.column(OFF).to_numpy()))
        return pa.table({FRAG: pa.array([key[0].as_py()], pa.int32()), "content": pa.array([content], pa.binary())})

    made, out = positions.select(F.col(FRAG).cast("int").alias(FRAG), F.col(OFF).cast("bigint").alias(OFF)), []
    for file in made.groupBy(FRAG).applyInArrow(encoded, f"{FRAG} int, content binary").toLocalIterator():
        path = deletion_path(root, file[FRAG], read_version, file[FRAG], kind)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
        try:
            stream.write(bytearray(file["content"]))
        finally:
            stream.close()
        out.append(path)
    return out
