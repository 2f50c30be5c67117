"""One document of each group of near copies: SimHash fingerprints compared bit-sliced, and an exact check.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more
(`SIMILAR`), and a group is what such pairs join. Fingerprints at that similarity differ in more bits than any
choice of bands can find, so texts meet in buckets of their least shingle hashes instead (`BANDS` of `ROWS` each:
at similarity 0.8 two texts share none of them once in 14,000 pairs), and within a bucket the bit-sliced comparison
of simhash.py picks the pairs of wide fingerprints, 256 bits, that differ in `RADIUS` or fewer (at similarity 0.8
once in 800 pairs they differ in more). What is picked is then checked exactly on the sets of whole texts.

A bucket is never turned into all its pairs. At first each text meets its neighbours in `CHAINS` random orders of
the bucket, so a crowd of any size is mostly one group after work in proportion to it; after that, only texts of a
bucket that aren't in one group yet are compared, in cells of bounded size, which send on a spanning forest.

Defined results: the row of the smallest id of a group stays, of equal ids (and of rows without id, which come last)
the first in the frame's order, so repeated rows go and rows of one id with different texts are different documents.
Null and empty texts are equal; texts without words are near copies of each other; texts of fewer than five words
are one shingle. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import simhash
from cairn.llm.components import connected
from cairn.llm.frames import fresh, map_columns, materialise, scratch

SHINGLE, SIMILAR = 5, (4, 5)
#: Buckets of each text, and least hashes that make a bucket's key.
BANDS, ROWS = 24, 5
#: 64-bit words of a wide fingerprint, and the most bits in which near copies' fingerprints differ.
WORDS, RADIUS = 4, 56
CHAINS = 2
#: Texts of a bucket that one order or one block of a cell holds.
CELL = 1024
#: Row numbers that one bitmap holds (what Spark's bitmap function makes).
RUN = 1 << 15

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _constants(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(salt)
    return rng.integers(1 << 63, size=n, dtype="u8") * np.uint64(2) + np.uint64(1), rng.integers(1 << 63, size=n, dtype="u8")


_ODD, _PLUS = _constants(BANDS * ROWS, 42)
_SPREAD, _ = _constants(WORDS, 43)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text."""
    words = (text or "").encode().lower().split()
    slices = range(0, max(1, len(words) - size + 1), simhash.SLICE_WORDS)
    return np.unique(np.concatenate([simhash.shingle_hashes(words[at : at + simhash.SLICE_WORDS + size - 1], size) for at in slices]))


def bucket_keys(shingles: np.ndarray) -> np.ndarray:
    """`BANDS` bucket keys; two sets share each with the power `ROWS` of their Jaccard similarity."""
    least = np.full(BANDS * ROWS, np.iinfo("u8").max)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        least = np.minimum(least, ((part ^ part >> np.uint64(31)) * _ODD[:, None] + _PLUS[:, None]).min(1))
    keys = np.arange(1, BANDS + 1, dtype="u8")
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys.view("i8")


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """`WORDS` words; a bit is 1 if over half of the shingles' own bits are."""
    ones = np.zeros(64 * WORDS, "i8")
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096, None]
        own = (part ^ part >> np.uint64(32)) * _SPREAD
        own ^= own >> np.uint64(29)
        own *= _MIX
        ones += np.unpackbits(own.view("u1"), axis=1, bitorder="little").sum(0, dtype="u2")
    return np.packbits(2 * ones > len(shingles), bitorder="little").view("i8")


def _sketches(columns) -> list[pa.Array]:
    sizes, keys, prints = [], [], []
    for t in columns[0]:
        own = shingle_set(t.as_py())
        sizes.append(len(own)), keys.append(bucket_keys(own)), prints.append(wide_fingerprint(own))
    lists = lambda xs, n: pa.ListArray.from_arrays(np.arange(0, len(xs) * n + 1, n, dtype="i4"), np.concatenate([np.empty(0, "i8"), *xs]))
    return [pa.array(sizes, pa.int64()), lists(keys, BANDS), lists(prints, WORDS)]


def _alike_in_size(a: str, b: str) -> Column:
    return F.least(a, b) * SIMILAR[1] >= F.greatest(a, b) * SIMILAR[0]


def _pairs(df: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller node first."""
    return materialise(df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def chained(members: DataFrame) -> DataFrame:
    """Candidates ``(a, b)`` of ``(key, node, size, n, print)``: near fingerprints among the neighbours in random orders
    of each bucket. An order holds about `CELL` texts of a bucket, and each of the `CHAINS` deals a larger bucket's
    texts out anew."""
    spun = members.withColumn("chain", F.explode(F.array(*map(F.lit, range(CHAINS)))))
    spun = spun.withColumn("part", F.pmod(F.xxhash64("node", "chain"), F.ceil(F.col("n") / CELL)))
    order = Window.partitionBy("key", "chain", "part").orderBy(F.xxhash64("chain", "node"), "node")
    beside = spun.select(F.col("node").alias("a"), "size", "print", F.lag(F.struct("node", "size", "print")).over(order).alias("next"))
    bits = sum(F.bit_count(F.col("print")[i].bitwiseXOR(F.col("next.print")[i])) for i in range(WORDS))
    return beside.filter(F.col("next").isNotNull() & _alike_in_size("size", "next.size") & (bits <= RADIUS)).select("a", F.col("next.node").alias("b"))


def _near(cells: pa.Table) -> pa.RecordBatch:
    """Links of whole cells' texts, a spanning forest of them: near fingerprints of different groups and like sizes,
    whose sets are then compared exactly."""
    n = cells.num_rows
    key, cell, node, group, size = (cells.column(c).to_numpy() for c in ("key", "cell", "node", "root", "size"))
    prints = np.asarray(cells.column("print").combine_chunks().flatten()).reshape(n, WORDS)
    run = np.cumsum(np.append(0, (np.diff(key) != 0) | (np.diff(cell) != 0)))
    pairs = [np.empty((2, 0), "i8")]
    for i, j in simhash.near_pairs(prints, run, int(np.bincount(run).max()) - 1, RADIUS):
        fit = (group[i] != group[j]) & (np.minimum(size[i], size[j]) * SIMILAR[1] >= np.maximum(size[i], size[j]) * SIMILAR[0])
        pairs.append(np.stack([i[fit], j[fit]]))
    left, right = np.concatenate(pairs, axis=1)
    a, b = [], []
    if len(left):
        order = np.argsort(left, kind="stable")
        left, right = left[order], right[order]
        needed = np.union1d(left, right)
        sets = [np.frombuffer(x.as_buffer(), "u8") for x in cells.column("shingles").take(pa.array(needed))]
        sizes = np.array([len(x) for x in sets])
        ends = np.cumsum(sizes)
        names, of = np.unique(np.concatenate(sets), return_inverse=True)
        own, at = np.searchsorted(needed, left), np.searchsorted(needed, right)
        marks, label = np.zeros(len(names), "i4"), np.unique(group, return_inverse=True)[1]
        joined = simhash.Forest(int(label.max()) + 1)
        firsts = np.flatnonzero(np.diff(left, prepend=-1))
        for start, stop in zip(firsts.tolist(), [*firsts[1:].tolist(), len(left)], strict=True):
            x, me = int(left[start]), int(own[start])
            apart_ = np.flatnonzero(joined.parent[label[right[start:stop]]] != joined.root(int(label[x]))) + start
            mine = of[ends[me] - sizes[me] : ends[me]]
            marks[mine] = 1
            for some in np.split(apart_, range(256, len(apart_), 256)):
                lengths = sizes[at[some]]
                sums = np.append(0, np.cumsum(marks[np.concatenate([of[:0], *[of[ends[k] - sizes[k] : ends[k]] for k in at[some].tolist()]])]))
                stops = np.cumsum(lengths)
                both = sums[stops] - sums[stops - lengths]
                for k in some[both * SIMILAR[1] >= (len(mine) + lengths - both) * SIMILAR[0]].tolist():
                    p, q = joined.root(int(label[x])), joined.root(int(label[right[k]]))
                    if p != q:
                        joined.parent[max(p, q)] = min(p, q)
                        a.append(node[x]), b.append(node[right[k]])
            marks[mine] = 0
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one partition, whole cells at a time; a cell's size is bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key, cell = batch.column("key").to_numpy(), batch.column("cell").to_numpy()
        differs = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        if held and (held[-1].column("key")[-1].as_py(), held[-1].column("cell")[-1].as_py()) != (int(key[-1]), int(cell[-1])) and not cut:
            yield _near(pa.Table.from_batches(held))
            held = []
        if cut:
            yield _near(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _near(pa.Table.from_batches(held))


def apart(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between different groups of a bucket, of ``(key, node, size, n, print, root)`` and the
    nodes' ``shingles``: enough of them for what the groups join to."""
    several = rooted.groupBy("key").agg((F.min("root") < F.max("root")).alias("several")).filter("several").select("key")
    # a bucket's texts are dealt out in blocks, and each pair of blocks is a cell
    blocks, block = F.ceil(F.col("n") / CELL), F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CELL))
    rows = rooted.join(several, "key", "left_semi").withColumns({"blocks": blocks, "block": block})
    cell = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda other: F.least("block", other) * F.col("blocks") + F.greatest("block", other)))
    dealt = rows.join(sets, "node").select("key", cell.alias("cell"), "node", "size", "root", "print", "shingles").repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    return dealt.mapInArrow(_by_cell, "a bigint, b bigint")


def similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those ``(a, b)`` pairs whose ``(node, shingles)`` have a Jaccard similarity of `SIMILAR` at least."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * SIMILAR[1] >= (len(x) + len(y) - both) * SIMILAR[0])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sided = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    sided = sided.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return materialise(sided.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"), "similar")


def among(rows: DataFrame, row: str, nodes: DataFrame) -> DataFrame:
    """The rows whose number is a ``node``. The nodes are put together to a bitmap of each run of `RUN` numbers, which
    is a bit a row: while those fit Spark's limit for broadcasts, rows and their texts aren't shuffled."""
    run, bits = fresh(rows, "__run", "__bits")
    place = lambda c: F.col(c).bitwiseAND(F.lit(RUN - 1))
    start = lambda c: F.shiftright(F.col(c), RUN.bit_length() - 1)
    maps = nodes.groupBy(start("node").alias(run)).agg(F.call_function("bitmap_construct_agg", place("node")).alias(bits))
    maps = materialise(maps, "maps")  # so its size is known when the join is planned
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(place(row) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.call_function("shiftright", byte, (place(row) % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return rows.join(maps, (start(row) == F.col(run)) & there, "left_semi")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without near copies of others: one of each group stays."""
    row, digest, size, keys, prints = names = fresh(docs, "__row", "__digest", "__size", "__keys", "__print")
    with scratch(docs.sparkSession) as tables:
        marked = docs.withColumns({row: F.monotonically_increasing_id(), digest: F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))})
        rows = materialise(map_columns(marked, [text_col], f"`{size}` bigint, `{keys}` array<bigint>, `{prints}` array<bigint>", lambda: _sketches), "rows")
        # a node is the row that stands for all of its text
        first, own = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("node"))), F.first(F.struct(size, keys, prints))
        distinct = rows.groupBy(digest).agg(first.alias("first"), own.alias("own"))
        distinct = materialise(distinct.select("first.*", *[F.col("own").getField(c).alias(n) for c, n in zip(names[2:], ("size", "keys", "print"), strict=True)]), "distinct")

        each = distinct.select("node", "size", F.explode("keys").alias("key"))
        members = each.join(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key")
        members = materialise(members.join(distinct.select("node", "print"), "node"), "members")
        sets = among(rows.select(F.col(row).alias("node"), F.col(text_col).alias("text")), "node", members.select("node"))
        sets = materialise(map_columns(sets, ["text"], "shingles binary", lambda: lambda c: [pa.array([shingle_set(t.as_py()).tobytes() for t in c[0]], pa.binary())], ["node"]), "sets")

        found = similar(sets, _pairs(chained(members)))
        roots = connected(found)
        rooted = materialise(members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        more = materialise(apart(rooted, sets), "more")
        if not more.isEmpty():
            roots = connected(found.unionByName(more))
        # the node of the smallest id stands for a group
        grouped = distinct.select("none", "id", "node").join(roots, "node")
        best = grouped.groupBy("root").agg(F.min(F.struct("none", "id", "node")).alias("best")).select("best.node")
        gone = roots.select("node").join(best, "node", "left_anti")
        kept = distinct.select("node").join(gone, "node", "left_anti")
        return tables.keep(among(rows, row, kept).select(*[F.col(f"`{c}`") for c in docs.columns]), "kept")
