"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Chat logs often hold the same conversation several times, each snapshot longer by a few turns.
Every turn gets a rolling hash of the conversation up to it; a conversation whose last hash is a
hash inside a longer one is a prefix of it and is dropped by an anti-join; of equal conversations
the smallest id stays. What remains is rendered with a template.

Defined results: turns are taken in order of (turn, role, digest of the text), nulls first; null role or text is
rendered as an empty string but differs from one when prefixes are compared; rows repeated in a
conversation are turns of their own; a turn without a conv_id is a conversation of that one turn; very long
texts are hashed and rendered whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import durable, quoted


def turn_hashes() -> tuple[Column, Column]:
    null_role, null_text = F.col("role").isNull(), F.col("text").isNull()
    return F.xxhash64(null_role, null_text, "role", "text"), F.xxhash64(F.lit(1), "text", null_text, "role")


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, idx, p1, p2, last: the rolling hash after each turn, and whether it is the last one.

    A turn's hash is mixed with its position, so that their running xor depends on the order. Two
    hashes of 64 bits make up the key. Only ids, turn numbers and hashes are shuffled, not texts.
    """
    h1, h2 = turn_hashes()
    slim = turns.select("conv_id", "turn", h1.alias("h1"), h2.alias("h2"), "role", F.sha2("text", 256).alias("tie"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = slim.withColumn("idx", F.row_number().over(order))
    rolled = numbered.withColumn("p1", F.bit_xor(F.xxhash64("idx", "h1")).over(upto)).withColumn("p2", F.bit_xor(F.xxhash64("h2", "idx")).over(upto))
    return rolled.select("conv_id", "idx", "p1", "p2", F.lead("idx").over(order).isNull().alias("last"))


def lone_turns(turns: DataFrame) -> DataFrame:
    """n_turns (1), p1, p2, n_copies, role, text: the turns without a conv_id, equal ones as one row, counted before they are shuffled."""
    h1, h2 = turn_hashes()
    lone = turns.where("conv_id IS NULL").groupBy("role", "text").agg(F.count(F.lit(1)).alias("n_copies"))
    return lone.select(F.lit(1).alias("n_turns"), F.xxhash64(F.lit(1), h1).alias("p1"), F.xxhash64(h2, F.lit(1)).alias("p2"), "n_copies", "role", "text")


def maximal_conversations(turns: DataFrame, lone: DataFrame | None = None) -> DataFrame:
    """One row a conversation that no other continues: conv_id (null where only lone turns say the same), n_turns, p1, p2, n_copies."""
    prefixes = durable(turn_prefixes(turns.where("conv_id IS NOT NULL")))
    ends = prefixes.where("last").groupBy(F.col("idx").alias("n_turns"), "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    lone = lone_turns(turns) if lone is None else lone
    more = lone.select("n_turns", "p1", "p2", F.lit(None).cast(turns.schema["conv_id"].dataType).alias("conv_id"), "n_copies")
    whole = ends.unionByName(more).groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.sum("n_copies").alias("n_copies"))
    inner = prefixes.where("NOT last").select(F.col("idx").alias("n_turns"), "p1", "p2").distinct()
    return whole.join(inner, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", F.col("n_turns").cast("long"), "p1", "p2", "n_copies")


def render_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: str = "<|{role}|>\n{text}<|end|>\n") -> DataFrame:
    """conv_id, n_turns, n_copies, chat: each maximal conversation as one training text."""
    plain = turns.select(quoted(conv_col).alias("conv_id"), quoted(turn_col).alias("turn"), quoted(role_col).alias("role"), quoted(text_col).alias("text"))
    lone = lone_turns(plain)
    kept = durable(maximal_conversations(plain, lone))
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    piece = lambda role, text: F.concat(F.lit(head), F.coalesce(role, F.lit("")), F.lit(middle), F.coalesce(text, F.lit("")), F.lit(tail))
    texts = plain.join(kept.where("conv_id IS NOT NULL").drop("p1", "p2"), "conv_id")
    gathered = texts.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.sha2("text", 256).alias("tie"), "text"))).alias("turns"))
    chats = gathered.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: piece(t["role"], t["text"])), "").alias("chat"))
    alone = lone.drop("n_turns", "n_copies").join(kept.where("conv_id IS NULL"), ["p1", "p2"])
    return chats.unionByName(alone.select("conv_id", "n_turns", "n_copies", piece(F.col("role"), F.col("text")).alias("chat")))


ORACLE = """
    WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(text) NULLS FIRST) AS idx FROM conversations),
    s AS (SELECT *, string_agg(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) || chr(3), '') OVER (PARTITION BY conv_id ORDER BY idx) AS prefix, max(idx) OVER (PARTITION BY conv_id) AS n FROM t),
    whole AS (SELECT prefix, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM s WHERE idx = n GROUP BY prefix, n),
    kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM s WHERE idx < n))
    SELECT k.conv_id, k.n AS n_turns, k.n_copies, string_agg('<|' || coalesce(t.role, '') || '|>' || chr(10) || coalesce(t.text, '') || '<|end|>' || chr(10), '' ORDER BY t.idx) AS chat
    FROM kept k JOIN t USING (conv_id) GROUP BY ALL"""
