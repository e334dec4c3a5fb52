"""From documents to packed training sequences: language, toxicity, near-duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm import language_id, ngram_join, packing, suffix_dedup, toxicity
from larder.llm.common import release_memory, table
from larder.session import settle

#: No SQL states the fitted stages; tests hold each stage against its operator and the whole against plain Python.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language."""
    model = language_id.fit(language_id.training_rows(docs))
    release_memory()
    return language_id.keep_identified(docs, model)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; the labels of ``sf_dir`` train the model."""
    net = toxicity.fit(*toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    release_memory()
    return toxicity.keep_clean(docs, net)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles agree to 0.8."""
    return ngram_join.keep_one(docs, size=5, percent=80)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that start earlier."""
    return suffix_dedup.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.piece_digests(packing.pack(docs))


STAGES = [
    ("language id", language),
    ("toxicity", clean),
    ("n-gram jaccard join", distinct),
    ("suffix-array dedup", unrepeated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
