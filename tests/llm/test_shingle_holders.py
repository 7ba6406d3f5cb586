from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

import pytest

from provenlake.llm import fragment_join


def _made_rows(spark, since):
    """Rows that joins, generators and Python made in the executions after the first ``since``, as Spark's own metrics count them."""
    store = spark._jsparkSession.sharedState().statusStore()
    total, executions = 0, store.executionsList()
    for i in range(since, executions.size()):
        id = executions.apply(i).executionId()
        values, nodes = store.executionMetrics(id), store.planGraph(id).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if not re.search("Join|Generate|Arrow", node.name()):
                continue
            for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total


@pytest.mark.parametrize("stretch", [1 << 20, 500])
@pytest.mark.parametrize("batch", [10_000, 16])
def test_shingles_of_large_groups_are_no_rows(spark, monkeypatch, stretch, batch):
    """Sets with 0 to 60 of 300 shingles of their own, one that all hold among the others: found by count, with a row for a set and stretch at most."""
    monkeypatch.setattr(fragment_join, "STRETCH_SHINGLES", stretch, raising=False)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rng, threshold = random.Random(5), Fraction(90, 100)
    number = lambda: rng.randrange(-(2**63), 2**63)
    everywhere, pool = number(), [number() for _ in range(400)]
    sets = {}
    for node in range(-20, 41):
        own = rng.randint(0, 60)
        sets[node] = {everywhere, *(number() for _ in range(own)), *rng.sample(pool, 299 - own)}
    held = Counter(g for x in sets.values() for g in x)
    want = sorted(node for node, x in sets.items() if sum(held[g] > 1 for g in x) >= threshold * len(x))
    parts = [(node, f, len(x), sorted(g for g in x if g % 8 == f)) for node, x in sets.items() for f in range(8)]
    segments = fragment_join.durable(spark.createDataFrame(parts, "node long, f int, n long, part array<long>").repartition(3))
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    try:
        spark.conf.set(key, batch)
        got = sorted(r.node for r in fragment_join.may_link_any(segments, threshold).collect())
    finally:
        spark.conf.set(key, before)
    assert got == want and 0 < len(want) < len(sets)
    if stretch > 500:
        assert 0 < _made_rows(spark, since) <= 4 * len(sets)


def test_no_sets_at_all(spark):
    none = spark.createDataFrame([], "node long, f int, n long, part array<long>")
    assert fragment_join.may_link_any(none, Fraction(90, 100)).collect() == []
