"""Flows: ask (retrieve, answer, judge, commit) and verify (scan, compare, report), for many questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import claim_hash
from ..functions.text import query_terms
from ..operators import claims, pins, search


def retrieve(questions: DataFrame, passages: DataFrame, k: int = 8, citable: tuple[str, ...] = pins.CITABLE) -> DataFrame:
    """query_id, no (from 1), id, body, score: the numbered citable passages of each question.

    questions: query_id, text, vector; passages: doc_id, id, kind, title, body, vector.
    """
    rows = search.eligible(passages, kinds=list(citable))
    terms = questions.select("query_id", F.explode(query_terms(F.lower("text"))).alias("term"))
    hits = search.hybrid_search(questions, terms, passages, rows, ["title", "body"], k)
    return hits.join(rows.select("doc_id", "id", "body"), "doc_id").select("query_id", F.col("rank").alias("no"), "id", "body", "score")


def prompts(questions: DataFrame, found: DataFrame) -> DataFrame:
    """query_id, prompt."""
    listed = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "body"))), lambda x: F.concat(F.lit("["), x["no"].cast("string"), F.lit("] "), x["body"])), "\n\n").alias("context"))
    return questions.join(listed, "query_id").select("query_id", F.concat(F.lit("Answer from the numbered passages and cite them as [n].\n\n"), "context", F.lit("\n\nQuestion: "), "text").alias("prompt"))


def ask(questions: DataFrame, passages: DataFrame, complete: Callable[[DataFrame], DataFrame], pinned: DataFrame | None = None, k: int = 8) -> DataFrame:
    """query_id, no, kind, claim, n_sources, n_rejected, status: every claim of every answer, judged.

    ``complete`` turns query_id, prompt into query_id, answer; a question without passages isn't sent.
    A citation counts if its number was shown and the passage still is what was shown.
    """
    found = retrieve(questions, passages, k)
    answers = complete(prompts(questions, found))
    said = claims.classify_claims(answers, ["query_id"], "answer")
    cited = said.select("query_id", "no", F.explode_outer("citations").alias("cite"))
    met = cited.join(found.select("query_id", F.col("no").alias("cite"), "id"), ["query_id", "cite"], "left")
    if pinned is not None:
        met = met.join(pinned.where("NOT verified").select(F.col("ref_id").alias("id"), F.lit(True).alias("drifted")).distinct(), "id", "left")
    else:
        met = met.withColumn("drifted", F.lit(None).cast("boolean"))
    counted = met.groupBy("query_id", "no").agg(F.count("cite").alias("n_sources"), F.sum((F.col("cite").isNotNull() & (F.col("id").isNull() | F.coalesce("drifted", F.lit(False)))).cast("int")).alias("n_rejected"))
    judged = said.join(counted, ["query_id", "no"])
    supported = F.col("n_sources") > F.col("n_rejected")
    gate = claims.commit_gate(judged.where("kind = 'assertion'").select((F.col("query_id") * 100_000 + F.col("no")).alias("seq"), claim_hash(F.lit("belief"), F.col("claim")).alias("claim_hash"), F.lit("belief").alias("epistemic_type"), supported.alias("supported")))
    out = judged.withColumn("seq", F.col("query_id") * 100_000 + F.col("no")).join(gate.select("seq", "outcome"), "seq", "left")
    status = claims.contract_verdict(F.col("kind"), F.col("n_sources"), F.col("n_rejected"), F.col("outcome") == "refused", F.col("outcome") == "committed_with_debt")
    return out.select("query_id", "no", "kind", "claim", "n_sources", "n_rejected", status.alias("status"))


def gate_log(commits: DataFrame, expired: DataFrame, debts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gate events, audit events): commits go to both; expiries and payments only to the first, waivers only to the second.

    A refused commit was rolled back, so of its events only ``commit:blocked`` is left.
    """
    action = F.when(F.col("outcome") == "refused", "commit:blocked").when(F.col("outcome") == "committed_with_debt", "debt:minted").otherwise("commit:passed")
    c = commits.select(F.col("seq").cast("string").alias("subject"), action.alias("action"))
    e = expired.select(F.col("belief_id").cast("string").alias("subject"), F.lit("expire").alias("action"))
    paid = debts.where("status IN ('proposed_paid', 'paid')").select(F.col("debt_id").cast("string").alias("subject"), F.concat(F.lit("debt:"), "status").alias("action"))
    waived = debts.where("status = 'waived'").select(F.col("debt_id").cast("string").alias("subject"), F.lit("debt:waived").alias("action"))
    return c.unionByName(e).unionByName(paid), c.withColumn("action", F.concat(F.lit("gate:"), "action")).unionByName(waived)


def cover(checkpoints: DataFrame, seqs: DataFrame) -> DataFrame:
    """seq, no: the checkpoint that covers each sequence number. checkpoints: no, from_seq, to_seq (contiguous).

    The last checkpoint that starts at or before a number is the one; both sides are laid out in one order per
    chain, so no range join is needed.
    """
    both = checkpoints.select("chain", F.col("from_seq").alias("at"), F.struct("no", "to_seq").alias("c"), F.lit(None).cast("long").alias("seq")).unionByName(seqs.select("chain", F.col("seq").alias("at"), F.lit(None).cast("struct<no:long,to_seq:long>").alias("c"), "seq"))
    last = F.last("c", ignorenulls=True).over(Window.partitionBy("chain").orderBy("at", F.col("seq").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("c", last).where("seq IS NOT NULL AND c.to_seq >= seq").select("chain", "seq", "c.no")
