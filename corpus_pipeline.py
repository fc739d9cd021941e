"""A training corpus from raw documents: one operator after another, each stage a table of its own."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphledger.llm import toxicity
from graphledger.llm.common import table, written
from graphledger.llm.decontamination import decontaminated
from graphledger.llm.mixing import mix_sources
from graphledger.llm.ngram_jaccard import one_of_each
from graphledger.llm.token_binary import token_binary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labelled ones."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles at 0.8 connect, the one with the smallest doc_id stays."""
    return one_of_each(docs, words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover half or more of a benchmark item, in any order, go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), min_match=5, threshold=0.5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source weighs alike; documents stand as often as they draw, in random order."""
    return mix_sources(docs, seed=17)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids as Huffman-coded files, and what they hold."""
    return token_binary(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
    ("token_binary", tokenize),
]

#: Compression, tokenizers and components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
