from __future__ import annotations

import random
from fractions import Fraction

import pytest

from provenlake.llm import fragment_join

from test_near_copies_stage import kept_by_brute_force


def _cluster(rng, n_words, copies, edits):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(n_words)]
    for _ in range(copies):
        near = list(base)
        for at in rng.sample(range(n_words), rng.randint(1, edits)):
            near[at] = word()
        yield " ".join(near)


@pytest.mark.parametrize("block_group", [4096, 4])
def test_members_of_large_groups_link_once(spark, monkeypatch, block_group):
    """Near copies that share many frequent shingles: blocks give no link twice, and the components are those of all pairs."""
    for name, value in (("DIRECT_GROUP", 4), ("SMALL_GROUP", 4), ("BLOCK_NODES", 8), ("BLOCK_GROUP", block_group)):
        monkeypatch.setattr(fragment_join, name, value, raising=False)
    further, links = fragment_join.connected_further, []
    monkeypatch.setattr(fragment_join, "connected_further", lambda maps, found: (links.append(found.count()), further(maps, found))[1])
    rng = random.Random(3)
    rows = list(enumerate([*_cluster(rng, 120, 60, 4), *_cluster(rng, 90, 30, 3), *_cluster(rng, 200, 1, 1)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fragment_join.jaccard_components(docs, Fraction(80, 100), k=5).collect()
    want = kept_by_brute_force(rows)
    assert 5 < len(want) < 60
    assert {r.component_id for r in got} == want and {r.doc_id for r in got if r.doc_id == r.component_id} == want
    assert links[-1] < len(rows)
