"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, chat_snapshots, fragment_join, hamming_join, hard_negatives, link_trust, mixture, quality_knn, sentence_spans, suffix_decontam, token_windows, virtual_slots, weak_rules
from ._base import held_out, table


def op1_nearest_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_knn.score_quality(docs, quality_knn.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("rec.doc_id", held_out(F.col("rec.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge_pages(table(spark, sf_dir, "pages"))


def op3_tree_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture.mixed(table(spark, sf_dir, "documents"), keep=["doc_id"], **mixture.PRODUCTION)
    return rows.select("rec.doc_id", "domain", "lang", "source", "n_tokens", "copies")


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_slots.shard_documents(table(spark, sf_dir, "documents"), n_shards=8)


def op5_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = byte_cnn.identify(docs, byte_cnn.train(docs), keep=["doc_id"], with_text=False)
    return found.select("rec.doc_id", held_out(F.col("rec.doc_id")).alias("held_out"), "lang_pred", "score")


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = sentence_spans.dedup_spans(table(spark, sf_dir, "documents"), keep=["doc_id"], passage_words=sentence_spans.PASSAGE_WORDS)
    return clean.select("rec.doc_id", "n_sentences", "n_removed", "text")


def op8_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judge_documents(table(spark, sf_dir, "documents")).drop("votes")


def op9_vertical_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fragment_join.jaccard_components(table(spark, sf_dir, "documents"))


def op10_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_snapshots.render_chats(table(spark, sf_dir, "conversations"))


def op11_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hamming_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_windows.link_statistics(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_votes": op1_nearest_votes,
    "op2_link_trust": op2_link_trust,
    "op3_tree_budget": op3_tree_budget,
    "op4_virtual_slots": op4_virtual_slots,
    "op5_suffix_automaton": op5_suffix_automaton,
    "op6_byte_cnn": op6_byte_cnn,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_weak_rules": op8_weak_rules,
    "op9_vertical_fragments": op9_vertical_fragments,
    "op10_chat_snapshots": op10_chat_snapshots,
    "op11_hamming_join": op11_hamming_join,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_windows": op13_token_windows,
}

ORACLES: dict[str, str] = {
    "op2_link_trust": link_trust.ORACLE,
    "op3_tree_budget": mixture.ORACLE,
    "op5_suffix_automaton": suffix_decontam.ORACLE,
    "op8_weak_rules": weak_rules.ORACLE,
    "op9_vertical_fragments": fragment_join.ORACLE,
    "op10_chat_snapshots": chat_snapshots.ORACLE,
    "op11_hamming_join": hamming_join.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
