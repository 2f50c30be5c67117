"""The corpus pipeline: documents without toxic texts and near copies, secrets blanked out, sources mixed, encoded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, mixing, near_copies, secrets, toxicity
from cairn.llm.frames import drop_table, fresh, read, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject; its labels come from the labels table."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    prefix, verdict = fresh(docs, "__p_", "__toxic")
    judged = toxicity.judge(docs, model, prefix=prefix, verdict=verdict)
    return judged.filter(F.col(verdict) == 0).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return near_copies.one_of_each(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    model = secrets.train(secrets.labelled_samples(spark))
    (spans,) = fresh(docs, "__spans")
    found = secrets.scan(docs, model, out_col=spans)
    blanked = found.withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    chars = F.when(F.size(spans) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return blanked.withColumn("n_chars", chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the token budget takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns and their token ids."""
    return bpe.encode(docs, bpe.load(spark, bpe.default_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("secrets", blank_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: No SQL states the classifier chain, the fingerprints or the encoding; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's result is a table that the next one reads, which goes when
    the next one is written (the last one's input goes with the session)."""
    docs, base, before = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    drop_table(spark, base, at_exit=True)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            drop_table(spark, f"{base}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
