from __future__ import annotations

from hashlib import sha256

from pyspark.sql import functions as F

from provenlake.operators import mountains

FIRST = {1: 1, 2: 255, 3: 256, 4: 257, 5: 300, 6: 511, 7: 767, 8: 0, 9: 65_000}
THEN = {1: 1, 2: 1, 3: 256, 4: 300, 5: 1, 6: 700, 7: 2, 8: 3, 9: 1_000}


def nodes_of(hashes):
    """(height, place): hash of every whole node over the leaves."""
    out, level, height = {}, hashes, 0
    while level:
        out |= {(height, i): x for i, x in enumerate(level)}
        level, height = [sha256((level[i] + level[i + 1]).encode()).hexdigest() for i in range(0, len(level) - 1, 2)], height + 1
    return out


def test_appends_of_any_length_give_the_nodes_of_one_range(spark, monkeypatch):
    """Also behind stored peaks within a stretch of 256 leaves, at its end and over two of them; each round of heights is written once."""
    hashes = {c: [sha256(f"{c}/{i}".encode()).hexdigest() for i in range(FIRST[c] + THEN[c])] for c in FIRST}
    sizes = spark.createDataFrame([(c, FIRST[c], FIRST[c] + THEN[c]) for c in FIRST], "chain long, cut long, n long")
    entries = sizes.select("chain", "cut", F.explode(F.expr("sequence(0L, n - 1)")).alias("seq")).withColumn("hash", F.sha2(F.concat_ws("/", "chain", "seq"), 256))
    writes, durable = [], mountains.durable
    monkeypatch.setattr(mountains, "durable", lambda df: (writes.append(1), durable(df))[1])
    none = spark.createDataFrame([], "chain long, height int, place long, hash string")
    first, peaks = mountains.sync(none, entries.where("seq < cut").drop("cut"))
    assert len(writes) == 3  # heights 0 to 7, 8 to 15; the peaks
    more, _ = mountains.sync(peaks, entries.where("seq >= cut").drop("cut"))
    got = [(r.chain, r.height, r.place, r.hash) for r in first.unionByName(more).collect()]
    assert len(got) == len(set(got)) and set(got) == {(c, *at, x) for c in hashes for at, x in nodes_of(hashes[c]).items()}


def test_an_append_has_few_shuffles_whatever_its_height(spark, monkeypatch):
    """The first round, in which all leaves are, has no shuffle for each level."""
    plans, durable = [], mountains.durable
    monkeypatch.setattr(mountains, "durable", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), durable(df))[1])
    entries = spark.range(600).select(F.lit(1).cast("long").alias("chain"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    none = spark.createDataFrame([], "chain long, height int, place long, hash string")
    nodes = mountains.append_leaves(none, entries)
    plans.append(nodes._jdf.queryExecution().executedPlan().toString())
    assert max(p.count("Exchange hashpartitioning") for p in plans) <= 8
