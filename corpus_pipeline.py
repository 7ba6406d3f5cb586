"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

language id -> n-gram Jaccard join -> benchmark decontamination -> mixing to weights -> sharding

All stages but the last return the columns of their documents, whatever further columns there are; all give an
empty table for an empty one.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from provenlake.llm import byte_cnn, fragment_join, mixture, suffix_decontam, virtual_slots
from provenlake.materialise import released_shuffles, shared_folder

#: Below it no language is nearly likely enough: such a text is a word or two that several languages have.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go, and the others' ``lang`` is the one found, which the mixing stage weighs by.

    No language: the text is null, empty or without a letter, or no language has a score of LEAST_SCORE. Texts are
    read whole; repeated rows fare alike; of equally likely languages the first by name is taken. The network learns
    from the rows that have a language, whatever their number; if none may be learned from, every text with a letter
    stays as it is.
    """
    return byte_cnn.keep_identified(docs, byte_cnn.train(docs), least_score=LEAST_SCORE, lang_col="lang" if "lang" in docs.columns else None)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of five-word shingles of 0.8 or more, the one with the smallest id stays.

    Texts without a word link with nothing and stay; of rows with one id and one text one stays; a row without an id
    stays only where its group has no row with one.
    """
    return fragment_join.deduplicate(docs, threshold=Fraction(80, 100), k=5)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages of ten words or more, or whole shorter items, are cut out of the texts; a document that is mostly benchmark goes.

    Mostly: more than half of its words. Null and word-less texts stay as they are; repeated rows fare alike; with an
    empty benchmark nothing changes.
    """
    return suffix_decontam.remove_contamination(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt by the target weights; small sources repeat for up to three epochs.

    A document taken several times stands there as often; one beyond its leaf's budget goes. A null source or language
    is a child of its own, and one that the weights don't name has the least weight named, so neither vanishes. Null
    and empty texts have no tokens and cost nothing; rows of one leaf with equal ids are taken together or not at all.
    """
    return mixture.mix_documents(docs, **mixture.PRODUCTION | {"budget": 1.0})


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards of nearly equal bytes, by a stored slot map; null texts have no bytes, and every row is placed, repeated ones too."""
    return virtual_slots.shard_documents(docs, n_shards=8)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("mix", mix), ("shard", shard)]

#: A learned language model can't be written in SQL; tests/llm/test_pipeline.py compares every stage, and run(), with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with released_shuffles(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
