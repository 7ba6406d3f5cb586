"""Jobs whose tables of intermediate rows must grow with the input, against plain loops on small tables of awkward shapes."""

from __future__ import annotations

import random

import pandas as pd

from oracle import assert_same
from provenlake import queries
from provenlake.operators import claims, search


def _climb(up: dict, b: int) -> list[int]:
    """All that b revises, nearest first; b itself is none of it."""
    at, seen = up[b] if up[b] != b else None, []
    while at is not None and at not in seen:
        seen.append(at)
        at = up.get(at) if up.get(at) != at else None
    return [a for a in seen if a != b]


def _forest(seed: int) -> dict:
    """Chains, trees, cycles and tails that lead to them, some to claims that aren't there."""
    rng = random.Random(seed)
    up = {b: rng.choice([None, b, 500, *range(60)]) if b % 4 == 0 else b - 1 for b in range(60)}
    return up | {100: 103, 101: 100, 102: 101, 103: 102, 104: 102, 105: 104, 110: 111, 111: 110, 112: 110}


def test_revision_summaries_of_chains_and_cycles(spark):
    for seed in range(2):
        up = _forest(seed)
        beliefs = spark.createDataFrame(list(up.items()), "belief_id long, revision_of long")
        got = {r.belief_id: (r.n, r.deepest, r.first) for r in claims.revision_summaries(beliefs).collect()}
        # Steps round a cycle to a claim: as many as stand before it.
        assert got == {b: (len(a), len(a), min(a)) for b in up if (a := _climb(up, b))}


def test_inherited_debts_of_chains_and_cycles(spark):
    up = _forest(2)
    beliefs = spark.createDataFrame(list(up.items()), "belief_id long, revision_of long")
    owing = {7, 31, 103, 110}
    debts = spark.createDataFrame([(b, True, "pending") for b in owing] + [(8, True, "paid"), (9, False, "pending")], "belief_id long, blocking boolean, status string")
    got = sorted(r.belief_id for r in claims.inherited_debts(beliefs, beliefs, debts).collect())
    assert got == sorted(b for b in up if owing & set(_climb(up, b)))


def test_claim_pairs_of_texts_that_hold_the_added_numbers(spark, tmp_path):
    texts = ["12 pears", "14 and twelve", "nr. 12 to 16 14 18", "never 12, 14"]
    pd.DataFrame({"doc_id": [20, 40, 60, 80, 81, 24, 25, 30], "text": texts * 2}).to_parquet(tmp_path / "documents.parquet")
    assert_same(queries.QUERIES["claim_pairs"](spark, str(tmp_path)), queries.ORACLES["claim_pairs"], str(tmp_path))


def test_lexical_hits_by_blocks_are_those_of_one(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{n}" for n in range(12)]
    docs = spark.createDataFrame([(n, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for n in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, rng.choice(words)) for q in range(9) for _ in range(3)], "query_id long, term string")

    def hits():
        return sorted((r.query_id, r.lex_rank, r.doc_id, round(r.bm25, 9), round(r.lexical, 9)) for r in search.lexical_hits(asked, docs, "doc_id", "text", pool=7).collect())

    whole = hits()
    for name, value in (("LEXICAL_BLOCK", 2), ("BLOCKS_A_SCAN", 3), ("DENSE", 5)):
        monkeypatch.setattr(search, name, value)
    assert len(whole) == 63 and hits() == whole


def test_knn_in_pieces_of_rows(spark, monkeypatch):
    rng = random.Random(5)
    rows = spark.createDataFrame([(n, [rng.gauss(0, 1) for _ in range(4)]) for n in range(90)], "doc_id long, vector array<double>")
    asked = rows.where("doc_id < 5").withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, search.knn(asked, rows, 3).collect()))
    monkeypatch.setattr(search, "ROWS_AT_ONCE", 7)
    pieces = sorted(map(tuple, search.knn(asked, rows, 3).collect()))
    assert len(whole) == 15 and [(q, d, r) for q, d, _, r in pieces] == [(q, d, r) for q, d, _, r in whole]
