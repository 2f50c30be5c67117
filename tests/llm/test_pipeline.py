"""Each stage against brute force on its own input."""

import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cairn.llm import mixing, registry, secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{base}/{name}")
        out.append((docs, spark.read.parquet(f"{base}/{name}")))
        docs = out[-1][1]
    return out


def test_columns_and_run(spark, stages):
    for docs, made in stages[:-1]:
        assert made.columns == docs.columns
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()
    assert 4 <= len(stages) <= 5 and registry.queries()["pipeline"] is corpus_pipeline.run


def test_toxicity_stage(spark, stages):
    docs, made = stages[0]
    kept = {r.doc_id for r in made.select("doc_id").collect()}
    judged = {r.doc_id: r.is_toxic for r in registry.op5_toxicity_chain(spark, SF).collect()}
    assert kept == {i for i, t in judged.items() if not t} and 0 < len(kept) < docs.count()


def shingle_sets(docs):
    out = {}
    for r in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        out[r.doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    return out


def similar_pairs(sets):
    order = sorted(sets, key=lambda i: len(sets[i]))
    for at, a in enumerate(order):
        for b in order[at + 1 :]:
            if 5 * len(sets[a]) < 4 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                yield a, b


def test_near_copies_dropped_are_similar(stages):
    """Nothing goes but what has a document of a smaller id in its group of similar ones."""
    docs, made = stages[1]
    sets, kept = shingle_sets(docs.collect()), {r.doc_id for r in made.collect()}
    near = {i for pair in similar_pairs(sets) for i in pair}
    assert kept < sets.keys() and sets.keys() - kept <= near


def test_near_copies_stage_by_similarity(stages):
    """What stays is the smallest id of each component of all pairs at similarity 0.8."""
    docs, made = stages[1]
    sets = shingle_sets(docs.collect())
    root = {i: i for i in sets}
    for a, b in similar_pairs(sets):
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    assert sorted(r.doc_id for r in made.collect()) == sorted(set(root.values()))


def test_secrets_stage(stages):
    docs, made = stages[2]
    before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, made))
    assert before.keys() == after.keys()
    secret = re.compile(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}")
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and not any(secret.search(r.text) for r in after.values())
    for i in changed:
        parts = after[i].text.split(secrets.PLACEHOLDER)
        assert all(p in before[i].text for p in parts) and after[i].n_chars == len(after[i].text)


def test_mixing_stage(spark, stages):
    docs, made = stages[3]
    taken = sorted((r.doc_id, r.epoch) for r in mixing.mix(docs).collect())
    assert sorted(r.doc_id for r in made.collect()) == [i for i, _ in taken]


def test_encoding_stage(stages):
    docs, made = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = made.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.token_ids == library.encode(r.text, add_special_tokens=False).ids


def test_stages_on_odd_rows(spark, tmp_path):
    rng = random.Random(11)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(30_000))
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (2, "", None, None, 0), (None, "no id at all", "en", "a", 5), (None, "another without", "en", "a", 5), (3, long, "en", "a", 9), (4, long, "en", "a", 9), (5, "token = 'abcdefghijklmnopq' é", "de", "b", 1), (6, "x", "en", "a", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(*r, "t") for r in rows], kind + ", token_ids string")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for source in (df, df.limit(0)):
        docs = source
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.mode("overwrite").parquet(f"{tmp_path}/{source is df}/{i}")
            docs = spark.read.parquet(f"{tmp_path}/{source is df}/{i}")
            if i == 1 and source is df:
                assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(["1", "None", "None", "3", "5", "6"])
            if i == 2 and source is df:
                assert {r.text for r in docs.collect() if r.doc_id == 5} == {"[SECRET]' é"}
        assert docs.count() == 0 or source is df
