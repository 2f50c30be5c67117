"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has 64 bits; each is 1 if over half of the text's shingle hashes have it. Fingerprints
link at ``radius`` or fewer differing bits. Of ``bands`` into which the bits are split, two linked
fingerprints agree on all but ``radius``; so each distinct fingerprint goes, once for each choice of so
many bands, to the bucket of those bands' bits, and every link is found in some bucket.

Within sorted buckets comparison is bit-sliced: bit planes of all fingerprints are stored vertically,
plane XOR shifted plane gives one bit of the distance of every pair ``(i, i+k)`` at once, carry-save
counters add the bits up, and a block is abandoned as soon as all its pairs exceed the radius.
What a bucket sends on is a spanning forest of its links, so groups of copies never become pairs.

Defined results: a null or empty text, or one of white space, has fingerprint zero, and such
documents link like any others; repeated rows and ids share a fingerprint; a component's id is its
smallest non-null doc_id (null if it has none). Texts of any length are hashed whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.components import connected
from cairn.llm.frames import map_columns, materialise, scratch

BITS, SHINGLE, SEED = 64, 3, 42
#: Runs up to this length are compared together, longer ones each for itself; pairs a block.
SHORT_RUN, BLOCK = 512, 1 << 15
#: Longer runs are first split by the bits their bucket leaves free.
LONG_RUN = 1 << 14
SLICE_WORDS = 1 << 18


@dataclass(frozen=True)
class Scheme:
    """``radius`` and the widths of the bands, from the lowest bit; all but ``radius`` bands make a bucket."""

    radius: int = 2
    bands: tuple[int, ...] = (13, 13, 13, 13, 12)

    def spans(self) -> list[tuple[int, int]]:
        return list(zip([0, *accumulate(self.bands)], self.bands, strict=False))

    def choices(self) -> list[tuple[int, ...]]:
        return list(combinations(range(len(self.bands)), len(self.bands) - self.radius))

    def free_bits(self, choice: int) -> tuple[int, ...]:
        """Bits that a bucket's fingerprints may differ in."""
        kept = set(self.choices()[choice])
        return tuple(low + j for i, (low, width) in enumerate(self.spans()) if i not in kept for j in range(width))

    def key(self, fp: Column, choice: int) -> Column:
        mask = sum(((1 << width) - 1) << low for low, width in (self.spans()[i] for i in self.choices()[choice]))
        return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))


#: Links as near as the fixed definition has them.
CLOSE = Scheme()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words, joined by spaces; of all words if there are fewer."""
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], "u8")
    ends = list(accumulate(map((1).__add__, map(len, words))))
    starts = [0, *ends[: -size]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)], "u8")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    n, ones = 0, np.zeros(BITS, "i8")
    for at in range(0, max(1, len(words) - size + 1), SLICE_WORDS):
        hashes = shingle_hashes(words[at : at + SLICE_WORDS + size - 1], size)
        n += len(hashes)
        ones += np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "fingerprint", size: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """Add each text's fingerprint as ``bigint`` (its 64 bits, two's complement)."""

    def run(columns):
        made = np.array([fingerprint(t.as_py(), size) for t in columns[0]], "u8")
        return [pa.array(made.view("i8"))]

    return map_columns(df, [text_col], f"`{out_col}` bigint", lambda: run, keep)


def planes(values: np.ndarray) -> list[int]:
    """Bit planes: bit i of plane b is bit b of value i, which may be of several words."""
    bits = np.unpackbits(np.ascontiguousarray(values).view("u1").reshape(len(values), -1), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def _bits(mask: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(mask.to_bytes(-(-n // 8), "little"), "u1"), bitorder="little"))


def within(planes_: list[int], k: int, alive: int, radius: int) -> int:
    """Mask of the i in ``alive`` whose value and the one k places on differ in at most ``radius`` bits.

    The counters start so far up that the bit beyond the radius carries out of the top.
    """
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    counters = [alive if start >> j & 1 else 0 for j in range(width)]
    for plane in planes_:
        carry = (plane ^ plane >> k) & alive
        for j in range(width):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
            if not carry:
                break
        else:
            alive &= ~carry
            if not alive:
                return 0
    return alive


class Forest:
    """Union-find over positions, with labels refreshed for whole arrays."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def one(self, among: np.ndarray) -> bool:
        return bool((self.parent[among] == self.parent[among[0]]).all())

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.parent[a] != self.parent[b]
        if not new.any():
            return
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
        while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
            self.parent = up


def near_pairs(values: np.ndarray, keys: np.ndarray | None, last_k: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places ``(i, j)`` of all pairs up to last_k places apart (of one key, if keys are given, which are sorted)
    that differ in at most ``radius`` bits, some at a time."""
    n = len(values)
    for at in range(0, n, BLOCK):
        end = min(n, at + BLOCK + last_k)
        cut = planes(values[at:end])
        for k in range(1, min(last_k, end - at - 1) + 1):
            m = min(BLOCK, end - at - k)
            if keys is None:
                alive = (1 << m) - 1
            else:
                same = keys[at : at + m] == keys[at + k : at + k + m]
                if not same.any():
                    break
                alive = int.from_bytes(np.packbits(same, bitorder="little").tobytes(), "little")
            if found := within(cut, k, alive, radius):
                i = _bits(found, m) + at
                yield i, i + k


def _compare(values: np.ndarray, last_k: int, keys: np.ndarray | None, forest: Forest, base: np.ndarray, radius: int) -> None:
    """Link all pairs up to last_k places apart (of one key, if keys are given)."""
    if keys is None and forest.one(base):
        return
    for i, j in near_pairs(values, keys, last_k, radius):
        forest.join(base[i], base[j])
        if keys is None and forest.one(base):
            return


def _long_run(values: np.ndarray, base: np.ndarray, forest: Forest, free: tuple[int, ...], radius: int) -> None:
    """A long run: pairs agree on one of radius + 1 parts of the free bits, so it is split by each
    part in turn. What stays together then is crowded, and soon one component."""
    if len(values) <= LONG_RUN or len(free) <= radius:
        _compare(values, len(values) - 1, None, forest, base, radius)
        return
    for part in range(radius + 1):
        chosen = free[part * len(free) // (radius + 1) : (part + 1) * len(free) // (radius + 1)]
        key = values & np.uint64(sum(1 << b for b in chosen))
        order = np.argsort(key, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(own) > 1:
                _compare(values[own], len(own) - 1, None, forest, base[own], radius)


def _buckets(batches: Iterator[pa.RecordBatch], scheme: Scheme) -> Iterator[pa.RecordBatch]:
    """Sorted ``(bands, key, fp)`` rows of one partition to links ``(a, b)``; a bucket that goes on in
    the next batch waits for its end."""
    held = [np.empty(0, "i8")] * 3

    def links(bands: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        change = np.flatnonzero((np.diff(bands) != 0) | (np.diff(key) != 0)) + 1
        starts, ends = np.append(0, change), np.append(change, len(fp))
        run, values = np.repeat(np.arange(len(starts)), ends - starts), fp.view("u8")
        sizes, forest, at = ends - starts, Forest(len(fp)), np.arange(len(fp))
        short = np.flatnonzero((sizes[run] > 1) & (sizes[run] <= SHORT_RUN))
        if len(short):
            _compare(values[short], SHORT_RUN - 1, run[short], forest, at[short], scheme.radius)
        for r in np.flatnonzero(sizes > SHORT_RUN).tolist():
            own = slice(starts[r], ends[r])
            _long_run(values[own], at[own], forest, scheme.free_bits(int(bands[starts[r]])), scheme.radius)
        linked = np.flatnonzero(forest.parent != at)
        return pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[forest.parent[linked]])], names=["a", "b"])

    for batch in batches:
        now = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        n = len(now[0])
        if not n:
            continue
        differs = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(differs[-1]) + 1 if len(differs) else 0
        held = [x[cut:] for x in now]
        if cut:
            yield links(*(x[:cut] for x in now))
    if len(held[0]):
        yield links(*held)


def links(distinct: DataFrame, fp_col: str = "fingerprint", scheme: Scheme = CLOSE) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints, enough for their components."""
    fp = F.col(f"`{fp_col}`")
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("bands"), scheme.key(fp, i).alias("key")) for i in range(len(scheme.choices()))]))
    rows = distinct.select(each.alias("at"), fp.alias("fp")).select("at.bands", "at.key", "fp")
    dealt = rows.repartition("bands", "key").sortWithinPartitions("bands", "key", "fp")
    return dealt.mapInArrow(lambda batches: _buckets(batches, scheme), "a bigint, b bigint")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, scheme: Scheme = CLOSE) -> DataFrame:
    """``(<id>, fingerprint, component_id)`` of every row."""
    with scratch(docs.sparkSession) as tables:
        marked = tables.keep(fingerprints(docs.select(id_col, text_col), text_col, "fingerprint", size, [id_col]), "fingerprints")
        distinct = materialise(marked.groupBy("fingerprint").agg(F.min(id_col).alias("first")), "distinct")
        roots = connected(links(distinct, scheme=scheme))
        owned = materialise(distinct.join(roots, distinct["fingerprint"] == roots["node"]).select("fingerprint", "first", "root"), "owned")
        smallest = owned.groupBy("root").agg(F.min("first").alias("component_id"))
        moved = owned.join(smallest, "root").select("fingerprint", "component_id")
        named = tables.keep(distinct.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id")), "named")
    return marked.join(named, "fingerprint").select(id_col, "fingerprint", "component_id")
