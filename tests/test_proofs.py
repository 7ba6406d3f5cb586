from __future__ import annotations

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from provenlake.operators import chains

SIZES = {1: 1, 2: 2, 3: 3, 4: 255, 5: 256, 6: 257, 7: 511, 8: 768, 9: 66_000}


def parent(a, b):
    return sha256((a + b).encode()).hexdigest()


def tree(level):
    """All levels of a tree; an odd node is paired with itself."""
    out = [level]
    while len(out[-1]) > 1:
        x = out[-1]
        out.append([parent(x[i], x[min(i + 1, len(x) - 1)]) for i in range(0, len(x), 2)])
    return out


def path(levels, at):
    out = []
    for x in levels[:-1]:
        out.append((x[at ^ 1] if at ^ 1 < len(x) else x[at], at % 2 == 1))
        at //= 2
    return out


@pytest.fixture(scope="module")
def data(spark):
    hashes = {c: [sha256(f"{c}/{i}".encode()).hexdigest() for i in range(n)] for c, n in SIZES.items()}
    sizes = spark.createDataFrame(list(SIZES.items()), "chain long, n long")
    leaves = sizes.select("chain", F.explode(F.expr("sequence(0L, n - 1)")).alias("idx"))
    return hashes, leaves.withColumn("hash", F.sha2(F.concat_ws("/", "chain", "idx"), 256))


def wanted_places(spark):
    at = [(c, i) for c, n in SIZES.items() for i in sorted({0, 1, 2, 254, 255, 256, 300, 512, 767, 65_535, 65_536, n - 2, n - 1}) if 0 <= i < n]
    return at, spark.createDataFrame(at, "chain long, idx long")


def test_paths_of_long_and_short_chains(spark, data):
    hashes, leaves = data
    at, wanted = wanted_places(spark)
    trees = {c: tree(x) for c, x in hashes.items()}
    want = {(c, i): (hashes[c][i], path(trees[c], i)) for c, i in at}
    got = {(r.chain, r.idx): (r.hash, list(zip(r.siblings, r.was_right, strict=True))) for r in chains.prove_inclusion(leaves, wanted).collect()}
    assert got == want
    every = chains.prove_all(leaves)
    ok = chains.verify_inclusion(F.col("hash"), F.col("siblings"), F.col("was_right"), F.col("root"))
    assert {r.chain: (r.root, r.n, r.ok) for r in every.groupBy("chain", "root").agg(F.count(F.lit(1)).alias("n"), F.every(ok).alias("ok")).collect()} == {c: (trees[c][-1][0], n, True) for c, n in SIZES.items()}


def test_paths_in_mountains_of_long_and_short_chains(spark, data):
    hashes, leaves = data
    at, wanted = wanted_places(spark)
    peaks = {}
    for c, n in SIZES.items():
        start, peaks[c] = 0, []
        for height in range(n.bit_length() - 1, -1, -1):
            if n >> height & 1:
                peaks[c].append((start, start + 2**height, tree(hashes[c][start : start + 2**height])))
                start += 2**height
    want = {}
    for c, i in at:
        start, _, levels = next(p for p in peaks[c] if p[0] <= i < p[1])
        want[c, i] = (hashes[c][i], path(levels, i - start), levels[-1][0], [p[2][-1][0] for p in reversed(peaks[c])])
    got = {(r.chain, r.idx): (r.hash, list(zip(r.siblings, r.was_right, strict=True)), r.peak, r.peaks) for r in chains.prove_in_mountains(leaves, wanted).collect()}
    assert got == want
    roots = {r.chain: r.root for r in chains.mountain_roots(leaves).collect()}
    assert {r.chain: (r.n, r.root) for r in chains.prove_all_in_mountains(leaves).groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.max("root").alias("root")).collect()} == {c: (n, roots[c]) for c, n in SIZES.items()}


@pytest.mark.parametrize("name", ["merkle_proof_verify", "mountain_proof_verify"])
def test_paths_are_not_shuffled_once_a_level(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 12
