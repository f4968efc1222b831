"""The corpus pipeline: what is kept of `documents`, mixed and packed for training.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is
written as Parquet and read again as the next one's docs. All but the last keep the columns of docs,
whatever their names.

Null and empty texts, or without words: the classifier scores them like any, the join takes them as copies
of nothing (of those with one doc_id one stays), the mix takes no word of them, so they end there. Rows
without doc_id and different texts under one doc_id count by themselves, equal rows are copies. Ties: of a
group of copies the smallest doc_id stays, null last, then the least hash of the text. Without labels every
score is about 1/2, so no document is rejected. Empty tables give an empty result. Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import common, jaccard_join, mixing, packing, quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from `labels`, doesn't reject."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest doc_id (null last), of each group of near-duplicates (five words, 0.8)."""
    return jaccard_join.one_of_each(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, once for each epoch that takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    import public_tokenizers  # no other stage needs it

    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express a fitted classifier or a tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
