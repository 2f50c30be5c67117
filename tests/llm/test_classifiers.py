"""Linear models against brute force, and classifiers by held-out accuracy and edge cases."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import linear, quality, registry, toxicity

SF = "/root/testdata/sf0.01"


def rows_of(x):
    return linear.Rows(np.flatnonzero(r) for r in x)


def test_dual_coordinate_descent_reaches_the_primal_minimum():
    rng = np.random.default_rng(1)
    x = (rng.random((120, 30)) < 0.3).astype(float)
    y = (x @ rng.normal(size=30) + rng.normal(size=120) > 0).astype(int)
    scale, c, sign = rng.normal(size=30), 0.2, None
    w, b = linear.dual_coordinate_descent(rows_of(x), scale, y, c, epochs=2000)
    sign, z = np.where(y > 0, 1, -1), np.column_stack([x * scale, np.ones(120)])
    primal = lambda v: 0.5 * v @ v + c * np.maximum(0, 1 - sign * (z @ v)).sum()
    best = primal(np.append(w, b))
    v = np.zeros(31)
    for t in range(1, 20_000):  # subgradient descent
        v -= (v - c * z.T @ (sign * (sign * (z @ v) < 1))) / (t + 10)
    assert best <= primal(v) * 1.0005


def test_sparse_rows():
    rng = np.random.default_rng(2)
    x = (rng.random((9, 7)) < 0.4).astype(float)
    rows, w, v = rows_of(x), rng.normal(size=7), rng.normal(size=9)
    assert np.allclose(rows.dot(w), x @ w) and np.allclose(rows.spread(v, 7), x.T @ v)
    keep = np.array([-1, 0, -1, 1, 2, -1, 3])
    assert np.allclose(rows.only(keep).dot(w[[1, 3, 4, 6]]), x[:, [1, 3, 4, 6]] @ w[[1, 3, 4, 6]])


def test_logistic_and_platt_are_calibrated():
    rng = np.random.default_rng(3)
    x, truth = (rng.random((3000, 12)) < 0.5).astype(float), rng.normal(size=12)
    p = linear.sigmoid(x @ truth - 0.5)
    y = (rng.random(3000) < p).astype(int)
    w, _, b = linear.logistic(rows_of(x), np.zeros((3000, 0)), y, 12, steps=800)
    assert np.abs(linear.sigmoid(x @ w + b) - p).max() < 0.12
    a, b = linear.platt(3 * (x @ truth - 0.5), y)
    assert abs(a - 1 / 3) < 0.05 and abs(b) < 0.15


@pytest.fixture(scope="module")
def truth(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_query_on_held_out_labels(spark, truth):
    rows = registry.op2_quality_nbsvm(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, truth[r.doc_id].quality) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) >= 0.95


def test_held_out_labels_and_other_columns_never_matter(spark, truth):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    changed = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    models = [quality.fit(docs, x.filter(~quality.held_out(F.col("doc_id")))) for x in (labels, changed)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].b == models[1].b


def test_toxicity_query_finds_toxic_and_leaves_clean(spark, truth):
    rows = registry.op5_toxicity_chain(spark, SF).collect()
    known = [(r.is_toxic, truth[r.doc_id].toxic) for r in rows if r.doc_id in truth]
    clean = [a for a, b in known if b == 0]
    assert sum(clean) / len(clean) <= 0.01


def test_toxicity_of_unseen_labels(spark):
    large = "/root/testdata/sf0.1"  # some 4,000 labels, a tenth of them toxic
    labels = spark.read.parquet(f"{large}/labels.parquet")
    docs = spark.read.parquet(f"{large}/documents.parquet").select("doc_id", "text").join(F.broadcast(labels.select("doc_id")), "doc_id").cache()
    model = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    seen = {r.doc_id: r.toxic for r in labels.filter("doc_id % 2 = 1").collect()}
    judged = [(r.is_toxic, seen[r.doc_id]) for r in toxicity.judge(docs.filter("doc_id % 2 = 1"), model).collect()]
    docs.unpersist()
    toxic, clean = [a for a, b in judged if b == 1], [a for a, b in judged if b == 0]
    # In these tables about a tenth of the toxic labels are on texts without any toxic word.
    assert sum(toxic) / len(toxic) >= 0.88 and sum(clean) / len(clean) <= 0.01


def test_chain_feeds_earlier_probabilities():
    model = toxicity.Model(np.empty(0, "i8"), np.zeros((3, 0)), [np.zeros(0), np.array([4.0]), np.array([0.0, 8.0])], [2.0, -2.0, -4.0], toxicity.Settings())
    a, b, c = model.chain(np.zeros(3))
    sig = lambda z: 1 / (1 + np.exp(-z))
    assert np.allclose([a, b, c], [sig(2), sig(-2 + 4 * sig(2)), sig(-4 + 8 * b)])


ODD = [(1, None), (2, ""), (3, " \n"), (4, "é\U0001f600 \x00"), (5, "idiot " * 200_000), (5, "idiot " * 200_000), (None, "plain words here")]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ODD], "doc_id long, text string, SCORE string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(4, 1, 1), (99, 0, 0), (None, 0, 0), (3, None, None), (5, 7, 7)], "doc_id long, quality int, toxic int")):
        scored = quality.score(docs, quality.fit(docs, labels))
        assert scored.columns == ["doc_id", "text", "score"] and {round(r.score, 9) for r in scored.collect()} == {round(scored.first().score, 9)}
        judged = toxicity.judge(docs, toxicity.fit(docs, labels)).collect()
        assert len(judged) == len(ODD) and all(0 <= r.p_toxic <= 1 for r in judged)
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0


def test_slices_agree_with_whole_texts(monkeypatch):
    text = " ".join(f"Word{i % 37}, x" for i in range(500)) + " y y y" * 200 + " " + "z" * 300
    whole = quality.Features(18)(text)
    for size in (64, 7, 3):
        monkeypatch.setattr(quality, "SLICE_WORDS", size)
        assert np.array_equal(whole, quality.Features(18)(text))
    monkeypatch.setattr(quality, "LONG_TEXT", 1)
    assert np.array_equal(whole, quality.Features(18)(text))


def test_words_without_white_space_count_whole():
    same = "\u4e00" * 64
    a, b = same + "".join(chr(0x4E00 + i % 5000) for i in range(9000)), same + "\u4e01\u4e02"
    assert len(quality.Features(18)(a)) > len(quality.Features(18)(b)) + 5000
    words = toxicity.Words(toxicity.Settings())
    assert len(words(a)) > len(words(b)) + 5000


def test_repeated_ids_bound_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, quality int")
    sample = linear.labelled_sample(docs, labels, "quality", 10)
    rows, y, _ = linear.collect_features(sample, lambda: quality.Features(10), "quality")
    assert len(rows) == 2 and sorted(y.tolist()) == [0, 1]


def test_threshold_is_between_what_it_parts():
    p, y = np.array([0.9, 0.7, 0.04, 0.02, 0.01, 0.01]), np.array([1, 1, 0, 0, 1, 0])
    assert 0.04 < toxicity.parted(p, y) < 0.7
    assert toxicity.parted(np.array([0.9, 0.8]), np.array([1, 1])) <= 0.8
    assert toxicity.parted(np.array([0.02, 0.01]), np.array([1, 0])) == 0.05


def test_folds_choose_their_own_features():
    """A feature that only the held rows' labels show isn't chosen by the others."""
    y = np.array([0, 1] * 30)
    rows = linear.Rows([np.array([1, 3] if i < 20 and y[i] else [1]) for i in range(60)])
    settings = toxicity.Settings(bits=4)
    assert 3 in toxicity._reduced(rows, y, np.arange(60), settings)[0] and 3 not in toxicity._reduced(rows, y, np.arange(20, 60), settings)[0]
