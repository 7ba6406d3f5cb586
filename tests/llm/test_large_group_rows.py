from __future__ import annotations

import random

from provenlake.llm import fragment_join, hamming_join

from test_hamming_join import brute, found


def _joined_rows(spark, key, since):
    """Rows that joins on ``key`` made in the executions after the first ``since``, as Spark's own metrics count them."""
    store = spark._jsparkSession.sharedState().statusStore()
    total, executions = 0, store.executionsList()
    for i in range(since, executions.size()):
        id = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(id), store.planGraph(id).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" not in node.name() or f"[{key}#" not in node.desc():
                continue
            for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_a_leader_is_looked_up_once_for_each_group_and_node(spark):
    """48 groups of the same 40 members and one leader: 88 lookups, not one for each member of each group."""
    rows = [(key, node, 40, 1) for key in range(1000, 1048) for node in range(1, 41)]
    large = spark.createDataFrame(rows, "key long, node long, members long, leader long")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = fragment_join.mixed_groups(large, []).collect()
    assert sorted((r.key, r.node, r.members, r.root) for r in got) == [(1, node, 40, node) for node in range(1, 41)]
    assert 0 < _joined_rows(spark, "leader", since) <= 48 + 40


def test_members_that_link_with_none_are_not_compared(spark, monkeypatch):
    """Copies edited too much to link with any other meet in large groups; only those that may link go into blocks."""
    monkeypatch.setattr(hamming_join, "SMALL_GROUP", 4)
    compared, blocks = [], fragment_join._links_in_blocks
    monkeypatch.setattr(fragment_join, "_links_in_blocks", lambda groups, *rest: (compared.extend(r.node for r in groups.select("node").distinct().collect()), blocks(groups, *rest))[1])
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    base = [word() for _ in range(240)]
    texts = []
    for edits in [1] * 4 + [3] * 12 + [9] * 40:
        copy = list(base)
        for at in rng.sample(range(0, 240, 6), edits):
            copy[at] = word()
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    want = brute(rows)
    assert found(hamming_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert 16 < len({component for _, _, component in want}) < 56
    assert 1 < len(set(compared)) <= 16
