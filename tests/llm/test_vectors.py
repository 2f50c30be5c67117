"""Links and components against brute force and SQL; lossless codes."""

import dataclasses

import duckdb
import numpy as np
import pytest

from cairn.llm import registry, vectors


def brute(ids, x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (unit @ unit.T >= threshold) & ~np.eye(len(x), dtype=bool)
    root = np.array(ids)
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], np.iinfo("i8").max).min(1))
        if (low == root).all():
            return {i: (int(n), int(r), i == r) for i, n, r in zip(ids, linked.sum(1), root, strict=True)}
        root = low


def check(rows, expected, least=1.0):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert got.keys() == expected.keys()
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in expected.values())
    assert all(got[i][0] <= expected[i][0] for i in got) and found >= least * there
    if least == 1.0:
        assert got == expected


def test_query_matches_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    got = registry.op9_vector_dedup(spark, sf_dir)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(registry.OP9_SQL).fetchall())


@pytest.fixture(scope="module")
def crowd():
    """Random vectors, a dense crowd with copies, and loose chains around the threshold."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(900, 24))
    centre = rng.normal(size=24)
    crowd = centre + 0.12 * rng.normal(size=(500, 24))
    near = base[:300] + rng.uniform(0.1, 0.7, size=(300, 1)) * rng.normal(size=(300, 24))
    x = np.concatenate([base, crowd, crowd[:100], near]).astype("f4")
    return rng.permutation(len(x)).tolist(), x.astype("f8")


def test_cells_and_many_lists(spark, crowd):
    ids, x = crowd
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, n_links int")
    few = dataclasses.replace(vectors.Settings(), per_list=60, probes=1000, members=64, askers=100, codes=16)
    check(vectors.near_duplicates(df, settings=few).collect(), brute(ids, x))
    check(vectors.near_duplicates(df, settings=dataclasses.replace(few, probes=6)).collect(), brute(ids, x), least=0.9)


def test_recall_of_default_settings(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    expected = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], "f8"))
    check(registry.op9_vector_dedup(spark, d).collect(), expected, least=0.98)


def test_codes_lose_nothing():
    rng = np.random.default_rng(5)
    x = vectors._unit(rng.normal(size=(600, 20)))
    index = vectors.Index.fit(x[:200], 600, dataclasses.replace(vectors.Settings(), per_list=100, codes=8))
    near, codes, errors = index.assign(x)
    for at in range(len(index.coarse)):
        own = np.flatnonzero(near[:, 0] == at)
        true = np.sqrt(((x[:, None] - x[own][None]) ** 2).sum(2))
        table = np.sqrt(np.maximum(index.distances(x, at, codes[own].astype("i8")), 0))
        assert (np.abs(true - table) <= errors[own] + 1e-9).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, -0.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [0.9, 0.4]), (12, [0.0, 5.0]), (13, [1e-40, 0.0]), (14, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()), key=str)
    group = [(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (3, 5, 1, False), (11, 5, 1, False), (13, 5, 1, False)]
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12, 14)] + [(None, 0, None, True)]
    assert got == sorted(group + alone, key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_crowd_over_more_lists_than_probes(spark):
    """A crowd of a third of the rows, cut into many lists, keeps every link."""
    rng = np.random.default_rng(8)
    base, centre = rng.normal(size=(4000, 64)), rng.normal(size=64)
    x = np.concatenate([base, centre + 0.3 * rng.normal(size=(2000, 64))]).astype("f4").astype("f8")
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    many = dataclasses.replace(vectors.Settings(), per_list=60)
    check(vectors.near_duplicates(df, settings=many).collect(), brute(ids, x))


def test_each_length_links(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.1, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 2, 4), (5, 2, 4), (6, 2, 4)]


def test_repeated_ids_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.1]), (6, [1.0, 0.35]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == [(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True)]


def test_planted_links_over_many_lists(spark, tmp_path):
    """Pairs at cosines from 0.90 to 0.95 among 128 lists and more, with the default probes; by brute force and by SQL."""
    rng = np.random.default_rng(12)
    base = vectors._unit(rng.normal(size=(6000, 32)))
    off = rng.normal(size=(1500, 32))
    off -= (off * base[:1500]).sum(1, keepdims=True) * base[:1500]
    cosine = rng.uniform(0.9, 0.95, size=(1500, 1))
    x = np.concatenate([base, cosine * base[:1500] + np.sqrt(1 - cosine**2) * vectors._unit(off)]).astype("f4").astype("f8")
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    expected = brute(ids, x)
    assert sum(v[0] for v in expected.values()) > 2500
    settings = dataclasses.replace(vectors.Settings(), per_list=50)
    assert len(vectors.Index.fit(x, len(x), settings).coarse) >= 128
    check(vectors.near_duplicates(df, settings=settings).collect(), expected, least=0.98)


def test_sql_counts_links_of_planted_and_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(13)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, base[:20] + 0.1 * rng.normal(size=(20, 8)), base[:3]])
    ids = [*range(80), 0, 1, 55]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(90, None), (91, [0.0] * 8)], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted(map(tuple, registry.op9_vector_dedup(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(registry.OP9_SQL).fetchall()) and sum(r[1] for r in got) > 20
