"""From raw documents to training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents. Nulls, empty texts, repeated rows, empty tables
and extra columns are handled as each operator's docstring says.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from veilframe.llm.shared import Workspace

#: The vocabulary that the last stage counts tokens with; None: the one of the installed public tokenizers.
VOCABULARY = os.environ.get("CORPUS_VOCABULARY")

#: Stages aren't expressible in SQL (trees, sequence packing); tests hold each against a brute-force version.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, scores at 0.5 or more go."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the smallest id stays."""
    return exact_dedup.dedup(docs, spark)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8, the smallest id of each component stays."""
    return jaccard_join.keep_one(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by the production weights of domains, languages and sources; rows come once for each epoch."""
    return mixing.mix(docs, mixing.PRODUCTION)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in sequences of at most 2048."""
    vocabulary = VOCABULARY
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, vocabulary)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, from sf_dir's documents to sequences."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
        if before:
            work.drop(before)  # what a stage has read isn't needed any more
        before = name
    return docs
