"""The whole commit gate: pins, parents, defeaters, debts of the claim, of what it revises and of what it restates, strictness.

A refusal changes what later commits meet: a claim that was refused can't be revised or cited, and mints no debt. So commits depend on
earlier ones, but only on those they are tied to: by the same claim, by a revision, by a citation of a belief, or by a restated claim.
The ties are joins, their connected components are found in parallel, and each component is one sorted stream through a task, which
keeps what is committed and what is owed. Whether a commit met any open debt of another claim at all is asked of the whole
ledger, and answered afterwards by a running sum of what each event opened and closed.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialise import durable
from .claims import BLOCKING_TYPES, PARAPHRASE_MOST_CHARS
from .components import connected
from .ordered import running_before

OUTCOME = "seq long, outcome string, reason string, debt_ids array<long>, n_verified int, rejected array<string>, reached boolean, opened int, own_open int"


def _ties(commits: DataFrame, beliefs_cited: DataFrame, similar: DataFrame | None) -> DataFrame:
    """claim_hash, component: claims tied by revisions, citations or restatement."""
    of = commits.select(F.col("seq").alias("ref"), F.col("claim_hash").alias("v"))
    revised = commits.where("revision_of IS NOT NULL").select(F.col("claim_hash").alias("u"), F.col("revision_of").alias("ref"))
    cited = beliefs_cited.join(commits.select("seq", F.col("claim_hash").alias("u")), "seq").select("u", "ref")
    ties = revised.unionByName(cited).join(of, "ref").select("u", "v")
    if similar is not None:
        ties = ties.unionByName(similar.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return connected(ties.distinct()).select(F.col("node").alias("claim_hash"), F.col("root").alias("component"))


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, types, claims, parents, owed = object(), {}, {}, {}, defaultdict(dict)
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if row.component != at:
                at, types, claims, parents, owed = row.component, {}, {}, {}, defaultdict(dict)
            own = owed[row.claim_hash]
            if row.event != "commit":
                out.append((row.seq, row.event, None, sorted(own), 0, [], False, -sum(own.values()), 0))
                own.clear()
                continue
            asserts = row.epistemic_type in BLOCKING_TYPES
            cited = list(row.beliefs)
            known = [ref for ref in cited if ref in types]
            verified, rejected = row.n_corpus + len(known), sorted(row.reasons) + ["belief_not_found"] * (len(cited) - len(known))
            reached, debts, reason = False, set(), None
            if row.path == "fast" and asserts:
                reason, verified, rejected = "fast_path", 0, []
            elif row.no_pin:
                reason, verified, rejected = "source_missing_pin", 0, []
            elif row.revision_of == row.revision_of and row.revision_of is not None and int(row.revision_of) not in types:
                reason = "parent_not_found"
            elif any(types[ref] == "defeater" for ref in known):
                reason = "defeater_cannot_source"
            elif asserts:
                reached = True
                debts |= own.keys()
                up = None if row.revision_of is None or row.revision_of != row.revision_of else int(row.revision_of)
                while up is not None:
                    debts |= owed[claims[up]].keys()
                    up = parents[up]
                for other in row.similar:
                    debts |= {d for d, comparable in owed[other].items() if comparable}
                if debts:
                    reason = "open_debt"
                elif row.strict and not verified:
                    reason = "strict_without_sources" if not row.n_sources else "strict_none_verified"
            comparable = 0 < row.n_chars <= PARAPHRASE_MOST_CHARS
            open_now, opened = sum(v for v in own.values()), 0
            if reason is None:
                types[row.seq], claims[row.seq] = row.epistemic_type, row.claim_hash
                parents[row.seq] = None if row.revision_of is None or row.revision_of != row.revision_of else int(row.revision_of)
                if asserts and not verified:
                    own[row.seq], opened = int(comparable), int(comparable)
            outcome = "rejected" if reason else "committed_with_debt" if asserts and not verified else "committed"
            out.append((row.seq, outcome, reason, sorted(debts), verified, rejected, reached, opened, open_now))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])


def full_commit_gate(events: DataFrame, sources: DataFrame, similar: DataFrame | None) -> DataFrame:
    """seq, outcome, reason, debt_ids, n_verified, rejected, paraphrase of every commit, and the debts each payment or waiver closed.

    events: seq, event (commit, pay, waive), claim_hash, epistemic_type, text, path, revision_of (seq of the commit), strict; sources: seq, no,
    kind, ref (seq of the cited commit, for kind belief), pinned (has a snapshot hash), verified, reason (of other kinds, see ``pins.verify_pins`` without
    rescue); similar: a, b (claims that restate each other, both ways: alike enough, and not apart by ``claims_differ``), or None where no threshold is
    known for the vectors' model.

    Outcomes: committed, committed_with_debt, rejected, pay, waive. Reasons, in the order they are tried: fast_path, source_missing_pin,
    parent_not_found, defeater_cannot_source, open_debt, strict_without_sources, strict_none_verified. A debt's id is the seq of the
    commit that minted it. All open debts of restated claims count; there is no cap on how many are compared. paraphrase: not_applicable (types
    that don't assert), not_reached (refused before), no_candidates (no comparable debt of another claim was open), skipped (no threshold), ran.
    """
    events = durable(events.select("seq", "event", "claim_hash", "epistemic_type", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), "path", "revision_of", "strict"))
    belief = F.col("kind") == "belief"
    cited = sources.where(belief & F.col("pinned")).select("seq", "ref")
    per_commit = sources.groupBy("seq").agg(
        F.count(F.lit(1)).cast("int").alias("n_sources"), F.max(~F.col("pinned")).alias("no_pin"), F.sum((~belief & F.col("verified")).cast("int")).cast("int").alias("n_corpus"),
        F.collect_list(F.when(belief, F.col("ref"))).alias("beliefs"), F.collect_list(F.when(~belief & ~F.col("verified"), F.col("reason"))).alias("reasons"),
    )
    none = lambda t: F.array().cast(f"array<{t}>")
    rows = events.join(_ties(events.where("event = 'commit'"), cited, similar), "claim_hash", "left").join(per_commit, "seq", "left")
    if similar is not None:
        rows = rows.join(similar.groupBy(F.col("a").alias("claim_hash")).agg(F.collect_set("b").alias("similar")), "claim_hash", "left")
    else:
        rows = rows.withColumn("similar", none("string"))
    rows = rows.select(
        F.coalesce("component", "claim_hash").alias("component"), "seq", "event", "claim_hash", "epistemic_type", "n_chars", "path", "revision_of", F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"),
        F.coalesce("no_pin", F.lit(False)).alias("no_pin"), F.coalesce("n_corpus", F.lit(0)).alias("n_corpus"), F.coalesce("beliefs", none("bigint")).alias("beliefs"), F.coalesce("reasons", none("string")).alias("reasons"), F.coalesce("similar", none("string")).alias("similar"),
    )
    folded = durable(rows.repartition("component").sortWithinPartitions("component", "seq").mapInPandas(_fold, OUTCOME))
    known = running_before(folded, "seq", "opened", "open_before").join(events.select("seq", "epistemic_type"), "seq")
    asserts = F.col("epistemic_type").isin(list(BLOCKING_TYPES))
    state = (
        F.when(~F.col("outcome").isin("committed", "committed_with_debt", "rejected"), None).when(~asserts, "not_applicable").when(~F.col("reached"), "not_reached")
        .when(F.col("open_before") - F.col("own_open") <= 0, "no_candidates").otherwise("skipped" if similar is None else "ran")
    )
    return known.select("seq", "outcome", "reason", "debt_ids", "n_verified", "rejected", state.alias("paraphrase"))
