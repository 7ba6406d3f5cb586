"""Claims: classification of replies, verdicts, the commit gate with its debts, and payments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.claims import claims_differ
from ..functions.text import cited_indices
from ..functions.vectors import cosine

#: Fixed: the words that make a line an aporia, chatter or an assertion; tried in this order.
APORIA = r"(?i)\b(i don't know|unknown|uncertain|cannot verify|aporia|no evidence)\b"
CHATTER = r"(?i)\b(you said|you asked|noted|acknowledged|queued|see spend)\b"
ASSERTION = r"(?i)\b(is|are|was|were|will|must|always|never|fact:)\b"
BLOCKING_TYPES = ("belief", "commitment")
PARAPHRASE_MOST_CHARS, PARAPHRASE_CANDIDATES = 1000, 32
PAY_FLOOR, PAY_TOP = 0.35, 3


def claim_kind(line: Column) -> Column:
    return F.when(line.rlike(APORIA), "aporia").when(line.rlike(CHATTER), "chatter").when(line.rlike(ASSERTION) & (F.length(line) > 20), "assertion").otherwise("observation")


def classify_claims(replies: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """The id columns, no, kind, claim, citations: one row a line with content; a reply without any is one chatter row."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n+"), lambda x: F.trim(F.regexp_replace(x, r"^[-*•]\s*", "")))
    full = F.filter(lines, lambda x: x != "")
    rows = replies.select(*id_cols, F.posexplode_outer(F.when(F.size(full) > 0, full)).alias("no", "claim"), F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, 200).alias("head"))
    kind = F.when(F.col("claim").isNull(), "chatter").otherwise(claim_kind(F.col("claim")))
    claim = F.coalesce("claim", "head")
    return rows.select(*id_cols, F.coalesce("no", F.lit(0)).alias("no"), kind.alias("kind"), claim.alias("claim"), cited_indices(claim).alias("citations"))


def contract_verdict(kind: Column, n_sources: Column, n_rejected: Column, blocked: Column, minted: Column) -> Column:
    """ALLOWED, APORIA, REFUSED, DEBT or UNSUPPORTED."""
    return (F.when(kind == "chatter", "ALLOWED").when(kind == "aporia", "APORIA")
            .when(kind == "assertion", F.when(blocked, "REFUSED").when(minted, "DEBT").otherwise("ALLOWED"))
            .otherwise(F.when(n_sources - n_rejected > 0, "ALLOWED").otherwise("UNSUPPORTED")))


def commit_gate(commits: DataFrame) -> DataFrame:
    """seq, claim_hash, outcome: committed, committed_with_debt or refused.

    commits: seq, claim_hash, epistemic_type, supported. Only beliefs and commitments can be blocked. An
    unsupported one mints a blocking debt; while it is open every later one of the same claim is refused,
    supported or not. Without payments in between that is a property of what came before, so it is a
    running count and needs no loop.
    """
    order = Window.partitionBy("claim_hash").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    bound = F.col("epistemic_type").isin(list(BLOCKING_TYPES))
    open_before = F.coalesce(F.sum((bound & ~F.col("supported")).cast("int")).over(order), F.lit(0)) > 0
    outcome = F.when(bound & open_before, "refused").when(bound & ~F.col("supported"), "committed_with_debt").otherwise("committed")
    return commits.select("seq", "claim_hash", outcome.alias("outcome"))


def commit_gate_with_payments(events: DataFrame) -> DataFrame:
    """seq, claim_hash, outcome for commits with payments and waivers in between.

    events: seq, claim_hash, event (commit, pay, waive), epistemic_type, supported. A payment closes what is
    open; the state before an event is the last event that changed it, so a window is enough here too. A
    claim asserted again without support after a payment mints a second debt.
    """
    bound = (F.col("event") == "commit") & F.col("epistemic_type").isin(list(BLOCKING_TYPES)) & ~F.col("supported")
    change = F.when(bound, True).when(F.col("event").isin("pay", "waive"), False)
    order = Window.partitionBy("claim_hash").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    is_open = F.coalesce(F.last(change, ignorenulls=True).over(order), F.lit(False))
    blocks = F.col("epistemic_type").isin(list(BLOCKING_TYPES)) & is_open
    outcome = F.when(blocks, "refused").when(bound, "committed_with_debt").otherwise("committed")
    return events.withColumn("outcome", outcome).where("event = 'commit'").select("seq", "claim_hash", "outcome")


def revision_roots(beliefs: DataFrame, most_depth: int = 1 << 20) -> DataFrame:
    """belief_id, ancestor, depth: every claim that a belief revises, directly or not, and the fewest steps to it.

    beliefs: belief_id, revision_of (one at most). Pointers are doubled: after k rounds each belief points 2^k steps up and knows all
    ancestors within them, so rounds grow with the logarithm of the depth. A cycle ends where a round finds nothing new; a belief is no
    ancestor of its own.
    """
    from ..materialise import durable

    up = beliefs.where("revision_of IS NOT NULL AND revision_of <> belief_id").select("belief_id", F.col("revision_of").alias("ancestor"), F.lit(1).alias("depth"))
    found, jump, far = durable(up), durable(up.select("belief_id", F.col("ancestor").alias("mid"))), 1
    known = found.count()
    while far < most_depth and not jump.isEmpty():
        beyond = jump.join(found.select(F.col("belief_id").alias("mid"), "ancestor", (F.col("depth") + far).alias("depth")), "mid").where((F.col("ancestor") != F.col("belief_id")) & (F.col("depth") <= most_depth))
        found = durable(found.unionByName(beyond.select("belief_id", "ancestor", "depth")).groupBy("belief_id", "ancestor").agg(F.min("depth").alias("depth")))
        jump = durable(jump.join(jump.select(F.col("belief_id").alias("mid"), F.col("mid").alias("further")), "mid").select("belief_id", F.col("further").alias("mid")))
        far, before, known = 2 * far, known, found.count()
        if known == before:
            break
    return found


def _climbed(start: DataFrame, merged: dict[str, Column], done: Column) -> tuple[DataFrame, DataFrame]:
    """(finished, unfinished) rows of ``start`` after doubling their pointers, one row a belief throughout.

    start: belief_id, mid (the claim that it points to; null once there is none further up) and columns on the claims up to mid. A round gives
    each row the pointer and, by ``merged`` (of its own columns and of those of mid, which begin with __), the columns of its mid. Rows with ``done``
    or without a pointer rest; only the others are written again. What is unfinished after a logarithm of all rows stands on a cycle or below one,
    and its columns cover all that is above it.
    """
    from ..materialise import durable

    rows = durable(start)
    n, far, rests = rows.count(), 1, F.col("mid").isNull() | done
    finished, moving = [rows.where(rests)], rows.where(~rests)
    while far <= n and not moving.isEmpty():
        above = reduce(DataFrame.unionByName, [*finished, moving])
        above = above.select(F.col("belief_id").alias("mid"), F.col("mid").alias("__mid"), *[F.col(c).alias(f"__{c}") for c in merged], F.lit(True).alias("__met"))
        met = moving.join(above, "mid", "left")
        moved = durable(met.select("belief_id", F.col("__mid").alias("mid"), *[F.when(F.col("__met"), x).otherwise(F.col(c)).alias(c) for c, x in merged.items()]))
        finished, moving, far = [*finished, moved.where(rests)], moved.where(~rests), 2 * far
    return reduce(DataFrame.unionByName, finished), moving


def revision_summaries(beliefs: DataFrame) -> DataFrame:
    """belief_id, n, deepest, first: how many claims each belief revises, directly or not, the most steps to one, and the smallest.

    As ``revision_roots`` counted by belief, in one row a belief: pairs grow with the square of a chain's length, and are never made.
    """
    from ..materialise import durable

    up = durable(beliefs.where("revision_of IS NOT NULL AND revision_of <> belief_id").select("belief_id", F.col("revision_of").alias("mid")).distinct())

    def climb(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        start = edges.select("belief_id", "mid", F.lit(1).cast("long").alias("n"), F.col("mid").alias("first"), F.col("mid").alias("last"))
        return _climbed(start, {"n": F.col("n") + F.col("__n"), "first": F.least("first", "__first"), "last": F.col("__last")}, F.lit(False))

    finished, round_about = climb(up)
    out = finished.select("belief_id", "n", "first")
    if not round_about.isEmpty():
        ring = durable(round_about.select(F.col("mid").alias("belief_id")).distinct().join(round_about.select("belief_id", F.col("first").alias("ring")), "belief_id"))
        of = durable(ring.groupBy("ring").agg(F.count(F.lit(1)).alias("size"), F.min(F.when(F.col("belief_id") != F.col("ring"), F.col("belief_id"))).alias("second")))
        on = ring.join(of, "ring")
        out = out.unionByName(on.select("belief_id", (F.col("size") - 1).alias("n"), F.when(F.col("belief_id") == F.col("ring"), F.col("second")).otherwise(F.col("ring")).alias("first")))
        below = up.join(round_about.select("belief_id"), "belief_id", "left_semi").join(ring.select("belief_id"), "belief_id", "left_anti")
        led = climb(below)[0].join(on.select(F.col("belief_id").alias("last"), "ring", "size"), "last")
        out = out.unionByName(led.select("belief_id", (F.col("n") - 1 + F.col("size")).alias("n"), F.least("first", "ring").alias("first")))
    return out.select("belief_id", "n", F.col("n").cast("int").alias("deepest"), "first")


def inherited_debts(commits: DataFrame, beliefs: DataFrame, debts: DataFrame) -> DataFrame:
    """Commits (belief_id) with an open blocking debt on a claim they revise. debts: belief_id, blocking, status.

    Beliefs carry the smallest and the largest claim with such a debt above them, so that one on a cycle isn't its own; who has found
    another one rests.
    """
    owing = debts.where("blocking AND status IN ('pending', 'proposed_paid')").select(F.col("belief_id").alias("mid"), F.col("belief_id").alias("owes")).distinct()
    up = beliefs.where("revision_of IS NOT NULL AND revision_of <> belief_id").select("belief_id", F.col("revision_of").alias("mid")).distinct()
    start = up.join(owing, "mid", "left").select("belief_id", "mid", F.col("owes").alias("low"), F.col("owes").alias("high"))
    found = (F.col("low") != F.col("belief_id")) | (F.col("high") != F.col("belief_id"))
    finished, rest = _climbed(start, {"low": F.least("low", "__low"), "high": F.greatest("high", "__high")}, F.coalesce(found, F.lit(False)))
    return commits.join(finished.unionByName(rest).where(found).select("belief_id").distinct(), "belief_id", "left_semi")


def paraphrase_debts(claims: DataFrame, debts: DataFrame, threshold: float | None, candidates: int = PARAPHRASE_CANDIDATES) -> DataFrame:
    """claim_id, debt_id, score, suppressed_by: open debts that a claim restates.

    claims: claim_id, claim_hash, text, vector; debts: debt_id, claim_hash, text, vector, created_at. The newest
    ``candidates`` debts of other claims take part; that is the operator's own bound. With at most ``candidates``
    of each claim, the newest 2 x ``candidates`` of all hold those of every claim, and they are broadcast. Without a
    threshold nothing is compared.
    """
    if threshold is None:
        return claims.sparkSession.createDataFrame([], "claim_id long, debt_id long, score double, suppressed_by string")
    age = [F.desc("created_at"), F.desc("debt_id")]
    each = debts.where(F.length("text") <= PARAPHRASE_MOST_CHARS).withColumn("rn", F.row_number().over(Window.partitionBy("claim_hash").orderBy(*age))).where(F.col("rn") <= candidates)
    newest = each.orderBy(*age).limit(2 * candidates)
    d = F.broadcast(newest.select("debt_id", "created_at", F.col("claim_hash").alias("d_hash"), F.col("text").alias("d_text"), F.col("vector").alias("d_vector")))
    c = claims.where(F.length("text") <= PARAPHRASE_MOST_CHARS)
    met = c.join(d, F.col("claim_hash") != F.col("d_hash")).withColumn("rn", F.row_number().over(Window.partitionBy("claim_id").orderBy(*age))).where(F.col("rn") <= candidates)
    met = met.withColumn("score", cosine(F.col("vector"), F.col("d_vector"))).where(F.col("score") >= threshold)
    return met.select("claim_id", "debt_id", "score", claims_differ(F.col("text"), F.col("d_text")).alias("suppressed_by"))


def propose_payment(hits: DataFrame, auto: bool = True) -> DataFrame:
    """debt_id, best, attached (the top passages, best first), status. hits: debt_id, doc_id, score.

    The top three are attached even where the payment is only proposed.
    """
    top = hits.withColumn("rn", F.row_number().over(Window.partitionBy("debt_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rn") <= PAY_TOP)
    got = top.groupBy("debt_id").agg(F.max("score").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "doc_id"))), lambda x: x["doc_id"]).alias("attached"))
    return got.withColumn("status", F.when((F.col("best") >= PAY_FLOOR) & F.lit(auto), "paid").otherwise("proposed_paid"))


def settle_debts(debts: DataFrame, decisions: DataFrame) -> DataFrame:
    """debt_id, status after decisions (debt_id, decision, reason): only open debts change, and a waiver needs a reason."""
    met = debts.join(decisions, "debt_id", "left")
    is_open = F.col("status").isin("pending", "proposed_paid")
    waive = (F.col("decision") == "waive") & (F.trim(F.coalesce("reason", F.lit(""))) != "")
    status = F.when(is_open & waive, "waived").when((F.col("status") == "proposed_paid") & (F.col("decision") == "confirm"), "paid").otherwise(F.col("status"))
    return met.select("debt_id", status.alias("status"))


def oldest_open(debts: DataFrame, most: int = 20) -> DataFrame:
    return debts.where("status IN ('pending', 'proposed_paid')").orderBy("created_at", "debt_id").limit(most)
