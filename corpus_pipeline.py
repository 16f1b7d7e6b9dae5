"""The corpus pipeline: language ID, toxicity, near-duplicate join and packing, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Rows with
nulls are taken as the operators' docstrings say: a null text has no letters, so the first stage
lets it go; an empty table stays empty; further columns, whatever their names, pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latticework.llm import jaccard_join, language_id, packing, toxicity
from latticework.llm.queries import vocabulary
from latticework.llm.scratch import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages."""
    return language_id.keep_identified(docs, folds=4, fold=2)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the model, learned from the labels of this corpus, doesn't call toxic."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), folds=5, fold=0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by the n-gram Jaccard join."""
    return jaccard_join.one_per_component(docs, n=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("packing", pack),
]

#: Learned models and tokenisers decide; SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's result is written as Parquet, read again, and dropped once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), ()
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(*before)
        before = (docs,)
    return STAGES[-1][1](spark, docs, sf_dir)
