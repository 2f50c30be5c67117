"""Near copies against all pairs by exact similarity."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import near_copies

from .test_pipeline import shingle_sets, similar_pairs


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words)


@pytest.fixture(scope="module")
def texts():
    """A crowd around the threshold, smaller groups, a passage that many share, copies, and odd texts."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, base = fresh(60), fresh(150)
    out = [edited(rng, base, rng.uniform(0, 0.05)) for _ in range(150)]
    for _ in range(25):
        own = fresh(rng.randint(30, 400))
        out += [edited(rng, own, rng.choice([0, 0.01, 0.02, 0.04, 0.08])) for _ in range(rng.randint(2, 4))]
    out += [" ".join(fresh(20) + passage + fresh(20)) for _ in range(80)]
    out += [out[3], out[3].upper(), "", " \n", "one two", "One  TWO", "a b c d e", "a b c d e", "\u00c9t\u00e9 x y z w", "\u00e9t\u00e9 x y z w"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("cell", [1024, 16])
def test_groups_are_those_of_all_pairs(spark, texts, cell, monkeypatch):
    monkeypatch.setattr(near_copies, "CELL", cell)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, __row string")
    got = near_copies.one_of_each(df)
    assert got.columns == df.columns
    sets = shingle_sets(df.collect())
    root = {i: i for i in sets}
    for a, b in similar_pairs(sets):
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root.values()))


def test_repeated_ids_and_missing_ones(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (3, a), (5, b), (5, b), (None, b), (None, "only here"), (None, "only here"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, map(tuple, near_copies.one_of_each(df).collect())))
    assert got == sorted(map(str, [(3, a), (5, b), (None, "only here"), (7, None)]))
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_cells_across_batches():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(120)]
    sets = [near_copies.shingle_set(edited(rng, words, 0.03)) for _ in range(60)]
    rows = [(k, c, i, len(sets[i]), i, near_copies.wide_fingerprint(sets[i]).tolist(), sets[i].tobytes()) for k in (1, 2) for c in (0, 1) for i in range(60) if (i + k + c) % 3]
    names = ["key", "cell", "node", "size", "root", "print", "shingles"]
    batch = lambda part: pa.RecordBatch.from_arrays([*(pa.array(x) for x in list(zip(*part, strict=True))[:5]), pa.array([r[5] for r in part], pa.list_(pa.int64())), pa.array([r[6] for r in part], pa.binary())], names=names)

    def groups(n):
        found = [r for b in near_copies._by_cell(iter([batch(rows[i : i + n]) for i in range(0, len(rows), n)])) for r in b.to_pylist()]
        root = list(range(60))
        for r in found:
            low, high = sorted((root[r["a"]], root[r["b"]]))
            root = [low if x == high else x for x in root]
        return root

    assert groups(len(rows)) == groups(7) == groups(1) and len(set(groups(7))) < 60


def test_sketches_estimate_similarity():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    x, y = near_copies.shingle_set(" ".join(words)), near_copies.shingle_set(edited(rng, words, 0.02))
    j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    shared = (near_copies.bucket_keys(x) == near_copies.bucket_keys(y)).sum()
    assert shared >= 1 and abs(shared / near_copies.BANDS - j**near_copies.ROWS) < 0.35
    bits = sum(int(v).bit_count() for v in (near_copies.wide_fingerprint(x) ^ near_copies.wide_fingerprint(y)).view("u8"))
    assert abs(bits / 256 - np.arccos(2 * j / (1 + j)) / np.pi) < 0.08
