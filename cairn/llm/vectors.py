"""Embedding near-duplicates with an inverted file and product quantisation.

Unit vectors belong to the list of their nearest coarse centroid; what is left of them is stored as
one code a subspace. Each vector asks every list that can hold a link of it (see `Index.asks`), and its
``probes`` nearest ones at least: distances to a list's members come from lookup tables (the asker isn't
quantised), a member stays a candidate unless the table distance less its own quantisation error already
exceeds the threshold, so neither lists nor codes lose anything; the candidates' cosines are then worked
out exactly, in double precision.

Equal vectors are compared once and counted as many times as they occur. Small lists are put together
into groups. The work of a group is a grid of cells of bounded size (blocks of members by blocks of
askers), so a list may hold any share of all vectors. A cell sends on counts and a spanning forest of its
links, never pairs. Of two groups only one is asked by the other's vectors, and a link counts for both ends.

Each length of vectors has an index of its own, fitted on a bounded sample (`Settings.sample`); every vector
is indexed and asks. Null, zero and non-finite vectors, those that hold nulls, and rows without an id link
with nothing; such a row is its own component. Rows count as separate vectors whatever their ids, so repeated rows
link with each other.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.components import connected
from cairn.llm.frames import materialise, scratch
from cairn.llm.simhash import Forest


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows that the index is fitted on; a list holds about ``per_list`` of them all
    (but there are at most ``most_lists``); ``members`` and ``askers`` bound a cell."""

    threshold: float = 0.9
    sample: int = 16_384
    per_list: int = 400
    most_lists: int = 1024
    probes: int = 8
    subspaces: int = 8
    codes: int = 128
    members: int = 2048
    askers: int = 8192


def _kmeans(x: np.ndarray, k: int, unit: bool, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        used = counts > 0
        centres[used] = sums[used] / counts[used, None]
        centres[~used] = x[rng.choice(len(x), int((~used).sum()))]
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)])


@dataclass
class Index:
    coarse: np.ndarray  # unit centroids
    books: np.ndarray  # subspace, code, part of the vector
    settings: Settings

    @classmethod
    def fit(cls, sample: np.ndarray, n: int, settings: Settings) -> Index:
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        unit = np.unique(unit, axis=0)
        lists = int(max(1, min(n // settings.per_list, settings.most_lists, len(unit) // 8)))
        coarse = _kmeans(unit, lists, unit=True)
        rest = unit - coarse[_nearest(unit, coarse)]
        parts = cls._parts(rest, settings.subspaces)
        k = min(settings.codes, len(unit))
        books = np.stack([_kmeans(parts[:, m], k, unit=False, seed=m) for m in range(settings.subspaces)])
        return cls(coarse, books, settings)

    @staticmethod
    def _parts(x: np.ndarray, m: int) -> np.ndarray:
        wide = -(-x.shape[1] // m) * m
        return np.pad(x, ((0, 0), (0, wide - x.shape[1]))).reshape(len(x), m, -1)

    def parts(self, x: np.ndarray) -> np.ndarray:
        return self._parts(x, self.settings.subspaces)

    def assign(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest lists (the first is the vector's own), codes, and quantisation errors."""
        near = np.argsort(-(unit @ self.coarse.T), axis=1, kind="stable")[:, : self.settings.probes]
        rest = self.parts(unit - self.coarse[near[:, 0]])
        codes = np.stack([_nearest(rest[:, m], self.books[m]) for m in range(rest.shape[1])], 1).astype("u1" if self.books.shape[1] <= 256 else "u2")
        off = rest - np.take_along_axis(self.books[None], codes.astype("i8")[:, :, None, None], 2)[:, :, 0]
        return near.astype("i4"), codes, np.sqrt((off * off).sum((1, 2)))

    def asks(self, unit: np.ndarray, homes: np.ndarray, radii: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Mask of the ``lists`` that each vector asks: its nearest, and all that can hold a link of it.

        A link's ends are ``turn`` apart at most, so a list is out if its centroid is further away than its
        radius (the angle to its farthest member) and ``turn``. Its members lie on its side of the plane between
        its centroid and the asker's own, so it's out as well if the asker is further than ``turn`` from the plane.
        """
        turn, near = np.arccos(self.settings.threshold) + 1e-6, unit @ self.coarse.T
        first = np.partition(near, -min(self.settings.probes, near.shape[1]), axis=1)[:, -min(self.settings.probes, near.shape[1])]
        own, near = np.take_along_axis(near, homes[:, None].astype("i8"), 1), near[:, lists]
        apart = np.sqrt(np.maximum(2 - 2 * self.coarse[homes] @ self.coarse[lists].T, 0))
        possible = (np.arccos(np.clip(near, -1, 1)) <= radii[lists] + turn) & (own - near <= np.sin(min(turn, np.pi / 2)) * apart + 1e-6)
        return possible | (near >= first[:, None])

    def distances(self, unit: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of askers to a list's members, by one table lookup a subspace."""
        rest = self.parts(unit - self.coarse[at])
        out = np.zeros((len(codes), len(unit)))
        for m, book in enumerate(self.books):
            table = (rest[:, m] ** 2).sum(1) - 2 * book @ rest[:, m].T + (book * book).sum(1)[:, None]
            out += table[codes[:, m]]  # whole rows of askers
        return out.T


_indexes: dict[str, Index] = {}


def _index(key: str, shared) -> Index:
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = pickle.loads(shared.value)
    return _indexes[key]


def _matrix(column: pa.Array, kind: str = "<f4") -> np.ndarray:
    return np.array([np.frombuffer(v, kind) for v in column.to_pylist()])


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors in double precision, stored as single floats if those are equal."""
    return np.array([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8") for v in column.to_pylist()], "f8")


def _keys(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, key, vec, dim)``: 16 bytes that equal vectors share, and the vector's floats; null if it can't link."""

    def run(batches):
        for batch in batches:
            keys, vecs, dims = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = None if i is None or not v or None in v else np.array(v, "<f8")
                if x is None or not np.isfinite(x).all() or not x.any():
                    keys.append(None), vecs.append(None), dims.append(None)
                    continue
                raw = (x + 0.0).tobytes()
                with np.errstate(over="ignore", under="ignore"):
                    short = x.astype("<f4")
                keys.append(hashlib.blake2b(raw, digest_size=16).digest()), dims.append(len(x))
                vecs.append((short + np.float32(0)).tobytes() if (short == x).all() else raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary()), pa.array(dims, pa.int32())], names=["id", "key", "vec", "dim"])

    return df.select(F.col(id_col).cast("bigint"), F.col(vector_col).cast("array<double>")).mapInArrow(run, "id bigint, key binary, vec binary, dim int")


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


_OUT = "node bigint, links bigint, root bigint"


def _cell(index: Index, radii: np.ndarray, table: pa.Table) -> pa.Table:
    """Links between one cell's members and askers."""
    settings, dim = index.settings, index.coarse.shape[1]
    is_member, foreign = (table.column(c).to_numpy() for c in ("member", "foreign"))
    ids, copies, homes = (table.column(c).to_numpy() for c in ("node", "copies", "home"))
    unit = _unit(_vectors(table.column("vec"), dim))
    askers, count, forest = np.flatnonzero(~is_member), np.zeros(len(ids), "i8"), Forest(len(ids))
    kind = "u1" if index.books.shape[1] <= 256 else "<u2"
    lists = []
    for at in np.unique(homes[is_member]).tolist():
        members = np.flatnonzero(is_member & (homes == at))
        codes = _matrix(table.column("code").take(pa.array(members)), kind).astype("i8")
        reach = (np.sqrt(max(0.0, 2 - 2 * settings.threshold)) + table.column("error").to_numpy()[members] + 1e-6) ** 2
        lists.append((at, members, codes, reach))
    for i in range(0, len(askers) if lists else 0, 256):
        block = askers[i : i + 256]
        asks = index.asks(unit[block], homes[block], radii, np.array([x[0] for x in lists]))
        for (at, members, codes, reach), asked in zip(lists, asks.T, strict=True):
            own = block[asked]
            if not len(own):
                continue
            maybe = index.distances(unit[own], at, codes) <= reach
            rows, cols = np.flatnonzero(maybe.any(1)), np.flatnonzero(maybe.any(0))
            if not len(rows):
                continue
            a, m = own[rows], members[cols]
            exact = maybe[np.ix_(rows, cols)] & (unit[a] @ unit[m].T >= settings.threshold) & (ids[a][:, None] != ids[m])
            count[a] += exact @ copies[m]
            # a member of another group doesn't ask the asker's and is told here
            count[m] += (copies[a] * foreign[a]) @ exact
            x, y = np.nonzero(exact)
            forest.join(a[x], m[y])
    found = np.flatnonzero((count > 0) | (forest.parent != np.arange(len(ids))))
    return pa.table([pa.array(ids[found]), pa.array(count[found]), pa.array(ids[forest.parent[found]])], names=["node", "links", "root"])


def _grouped(sizes: np.ndarray, most: int) -> np.ndarray:
    """The group of each list: runs of lists with ``most`` members at most, or one larger list."""
    groups, last, held = np.zeros(len(sizes), "i4"), 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            last, held = last + 1, 0
        groups[i], held = last, held + size
    return groups


def _linked(alike: DataFrame, dim: int, settings: Settings) -> DataFrame:
    """``(key, n_links, component_id)`` of the distinct vectors among ``(id, key, vec)`` rows of one length."""
    spark = alike.sparkSession
    distinct = alike.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    # ids may repeat, so each distinct vector has a number of its own
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    n = distinct.count()
    sample = distinct.select("vec").orderBy(F.xxhash64("key")).limit(settings.sample).collect()
    packed = pickle.dumps(Index.fit(_unit(_vectors(pa.array([r["vec"] for r in sample], pa.binary()), dim)), n, settings))
    name, shared = hashlib.sha256(packed).hexdigest(), spark.sparkContext.broadcast(packed)

    def assign(batches):
        index = _index(name, shared)
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_vectors(batch.column("vec"), dim))
                near, codes, errors = index.assign(unit)
                angles = np.arccos(np.clip((unit * index.coarse[near[:, 0]]).sum(1), -1, 1))
                made = [pa.array(near[:, 0]), pa.array(angles), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "home", "angle", "code", "error"])

    placed = distinct.select("node", "copies", "vec").mapInArrow(assign, "node bigint, copies bigint, vec binary, home int, angle double, code binary, error double")
    placed = materialise(placed, "placed")
    lists = len(pickle.loads(packed).coarse)
    radii, sizes = np.full(lists, -np.inf), np.zeros(lists, "i8")
    for r in placed.groupBy("home").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("size")).collect():  # a row a list
        radii[r["home"]], sizes[r["home"]] = r["radius"], r["size"]
    groups = _grouped(sizes, settings.members)

    def ask(batches):
        index = _index(name, shared)
        for batch in batches:
            made = [[], []]
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                homes = part.column("home").to_numpy()
                mask = np.add.reduceat(index.asks(_unit(_vectors(part.column("vec"), dim)), homes, radii, np.arange(lists)), np.flatnonzero(np.diff(groups, prepend=-1)), axis=1) > 0
                own, every = groups[homes][:, None], np.arange(mask.shape[1])
                # of two groups one is asked, by turns the lower and the higher
                mask &= (own < every) == ((own + every) % 2 == 0)
                mask[np.arange(len(own)), own[:, 0]] = True
                made[0] += own[:, 0].tolist()
                made[1] += [np.flatnonzero(m).tolist() for m in mask]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made[0], pa.int32()), pa.array(made[1], pa.list_(pa.int32()))], names=[*batch.schema.names, "own", "asked"])

    placed = placed.select("node", "copies", "vec", "home", "code", "error")
    placed = materialise(placed.mapInArrow(ask, "node bigint, copies bigint, vec binary, home int, code binary, error double, own int, asked array<int>"), "asked")

    # a group's grid: blocks of members by blocks of askers
    asked = placed.select(F.explode("asked").alias("group"), "own").groupBy("group").agg(F.count(F.lit(1)).alias("n_askers"), F.sum((F.col("group") == F.col("own")).cast("bigint")).alias("n_members"))
    grid = asked.select("group", F.ceil(F.col("n_members") / settings.members).cast("int").alias("rows"), F.ceil(F.col("n_askers") / settings.askers).cast("int").alias("columns"))
    grid = materialise(grid.filter("rows > 0"), "grid")
    place = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    cols = ["group", "row", "column", "member", "foreign", "node", "copies", "vec", "home", "code", "error"]
    members = placed.withColumn("group", F.col("own")).join(grid, "group").withColumns({"row": place("rows"), "column": F.explode(F.sequence(F.lit(0), F.col("columns") - 1)), "member": F.lit(True), "foreign": F.lit(False)})
    askers = placed.withColumn("group", F.explode("asked")).join(grid, "group").withColumns({"row": F.explode(F.sequence(F.lit(0), F.col("rows") - 1)), "column": place("columns"), "member": F.lit(False), "foreign": F.col("group") != F.col("own"), "code": F.lit(None).cast("binary"), "error": F.lit(0.0)})
    cells = members.select(cols).unionByName(askers.select(cols)).groupBy("group", "row", "column")
    found = materialise(cells.applyInArrow(lambda table: _cell(_index(name, shared), radii, table), _OUT), "found")

    roots = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = roots.withColumnRenamed("node", "__node")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = distinct.select("key", "id", "copies", "node").join(counts, "node", "left").join(roots, F.col("node") == F.col("__node"), "left")
    known = materialise(known.select("key", "id", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "known")
    # a component is named by its smallest id; what links with nothing is its own
    several = known.filter("n_links > 0").groupBy("root").agg(F.min("id").alias("component_id"))
    return materialise(known.join(several, "root", "left").select("key", "n_links", F.coalesce("component_id", "id").alias("component_id")), "named")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``(id, n_links, component_id, kept)`` of every row."""
    with scratch(df.sparkSession) as tables:
        marked = tables.keep(_keys(df, id_col, vector_col), "keys")
        dims = sorted(r["dim"] for r in marked.filter("dim is not null").select("dim").distinct().collect())
        known = None
        for dim in dims:
            found = _linked(marked.filter(F.col("dim") == dim), dim, settings)
            known = found if known is None else known.unionByName(found)
        if known is None:
            return marked.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
        known = tables.keep(known, "linked")
    # what can't link has no key, and no part in the join
    out = marked.filter("key is not null").select("id", "key").join(known, "key").select("id", "n_links", "component_id")
    out = out.unionByName(marked.filter("key is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
