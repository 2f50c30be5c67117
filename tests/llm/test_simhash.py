"""Fingerprints, bit-sliced comparison and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from cairn.llm import components, registry, simhash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(values, radius=2):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (int(values[i]) ^ int(values[j])).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


TEXTS = ["", " \t", "A b", "One TWO three", "É é x y\x0bz\x1cq", "a b c d " * 10, None, "\x85 x y z w", "one two THREE", "word " * 3000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text, monkeypatch):
    expected = slow_fingerprint(text)
    assert simhash.fingerprint(text) == expected
    monkeypatch.setattr(simhash, "SLICE_WORDS", 5)
    assert simhash.fingerprint(text) == expected


def near(rng, base, bits, most):
    return base ^ sum(1 << b for b in {rng.randrange(bits) for _ in range(rng.randint(0, most))})


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6, 7, 10])
def test_carry_save_counters(radius):
    rng = random.Random(radius)
    for _ in range(60):
        base = rng.getrandbits(64)
        values = np.array([near(rng, base, 64, radius + 3) if rng.random() < 0.7 else rng.getrandbits(64) for _ in range(rng.randint(2, 50))], "u8")
        planes = simhash.planes(values)
        for k in range(1, len(values)):
            expected = sum(1 << i for i in range(len(values) - k) if (int(values[i]) ^ int(values[i + k])).bit_count() <= radius)
            assert simhash.within(planes, k, (1 << (len(values) - k)) - 1, radius) == expected


@pytest.mark.parametrize("scheme", [simhash.CLOSE, simhash.Scheme(6, (8,) * 8)])
@pytest.mark.parametrize("longest", [1 << 14, 60, 5])
def test_long_runs_lose_no_link(longest, scheme, monkeypatch):
    monkeypatch.setattr(simhash, "LONG_RUN", longest)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = random.Random(longest)
    base = rng.getrandbits(64)
    free = scheme.free_bits(9)
    values = np.unique(np.array([base ^ sum(1 << b for b in {rng.choice(free) for _ in range(rng.randint(0, 3 * scheme.radius))}) for _ in range(400)], "u8"))
    forest = simhash.Forest(len(values))
    simhash._long_run(values, np.arange(len(values)), forest, free, scheme.radius)
    assert [forest.root(i) for i in range(len(values))] == slow_roots(values, scheme.radius)


@pytest.mark.parametrize("scheme", [simhash.CLOSE, simhash.Scheme(6, (8,) * 8)])
def test_links_find_all_components(spark, scheme):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([3, 60])):
            values.add(base := near(rng, base, 64, scheme.radius + 1))
    values = np.array(sorted(values), "u8")
    df = spark.createDataFrame([(int(v),) for v in values.view("i8")], "fingerprint long")
    got = {r.node: r.root for r in components.connected(simhash.links(df, scheme=scheme)).collect()}
    groups = {}
    for i, root in enumerate(slow_roots(values, scheme.radius)):
        groups.setdefault(root, []).append(int(values.view("i8")[i]))
    for own in groups.values():
        assert {got.get(v, v) for v in own} == {min(own)}


def test_near_pairs_of_wide_values():
    rng = np.random.default_rng(6)
    values = rng.integers(1 << 63, size=(70, 4), dtype="u8")
    values[20:50] = values[19] ^ (rng.integers(1 << 63, size=(30, 4), dtype="u8") & rng.integers(1 << 63, size=(30, 4), dtype="u8") & rng.integers(1 << 63, size=(30, 4), dtype="u8"))
    keys = np.sort(rng.integers(3, size=70))
    got = {(int(i), int(j)) for a, b in simhash.near_pairs(values, keys, 69, 56) for i, j in zip(a, b, strict=True)}
    distance = lambda i, j: sum(int(x).bit_count() for x in values[i] ^ values[j])
    assert got == {(i, j) for j in range(70) for i in range(j) if keys[i] == keys[j] and distance(i, j) <= 56} and len(got) > 50


def test_runs_across_batches():
    import pyarrow as pa

    rng = random.Random(12)
    values = np.unique(np.array([near(rng, 12345, 64, 2) for _ in range(900)], "u8")).view("i8")
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), "i8")), pa.array(np.zeros(len(x), "i8")), pa.array(x)], names=["bands", "key", "fp"])
    found = [list(simhash._buckets(iter([batch(values[i : i + n]) for i in range(0, len(values), n)]), simhash.CLOSE)) for n in (len(values), 37)]
    tables = [sorted(tuple(r.values()) for b in f for r in b.to_pylist()) for f in found]
    assert tables[0] == tables[1] and len(tables[0]) == len(values) - len(set(slow_roots(values.view("u8"))))


def test_components_of_odd_graphs(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000 + i, 999) for i in range(300)] + [(2000, i) for i in range(1500, 1600)]
    rng = random.Random(3)
    tangle = [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(250)]
    links = path + star + tangle + [(7, 7), (9000, 9000), (None, 3), (4, None)] + path[:5]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert got == {n: root(n) for n in parent}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def check(rows, texts):
    fps = {}
    for i, t in texts:
        fps.setdefault(slow_fingerprint(t), []).append(i)
    values = np.array(sorted(fps), "u8")
    expected, roots = {}, slow_roots(values)
    smallest = {}
    for v, r in zip(values.tolist(), roots, strict=True):
        ids = [i for i in fps[v] if i is not None]
        smallest[r] = min([*ids, *([smallest[r]] if smallest.get(r) is not None else [])], default=None)
    for v, r in zip(values.tolist(), roots, strict=True):
        for i in fps[v]:
            expected.setdefault(i, []).append((f"{v:016x}", smallest[r]))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(registry.op8_simhash_dedup(spark, sf_dir).collect(), docs)


def test_edge_rows(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "one two three"), (None, None)]
    base = [rng.choice(words) for _ in range(300)]
    for i in range(40):
        base[rng.randrange(300)] = rng.choice(words)
        rows.append((100 + i, " ".join(base)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    check(registry.op8_simhash_dedup(spark, str(tmp_path)).collect(), rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert registry.op8_simhash_dedup(spark, f"{tmp_path}/none").count() == 0
