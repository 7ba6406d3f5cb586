from __future__ import annotations

import math
import random

import numpy as np
import pytest

from provenlake.llm import hard_negatives

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows):
    """The contract in plain loops over rows of (vec_id, vector, label)."""
    used = set()
    for id, v, label in rows:
        if id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.add((id, (label + 1) % 10 if id % 7 == 0 else label, tuple(math.floor(256 * x) for x in v)))
    out = []
    for a in used:
        if a[0] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in used if r[0] != a[0] and len(r[2]) == len(a[2]))
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            fit = [(n, -t) for t, n, label in scored if label != a[1] and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a[0], p, i + 1, n, -s, t) for i, (n, t) in enumerate(fit)]
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


def made(rng, n, dims, labels=4, coarse=False):
    draw = (lambda: rng.choice([-0.5, -0.25, 0.0, 0.25, 0.5])) if coarse else (lambda: rng.gauss(0, 0.3))
    return [(i, [draw() for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("dims", "coarse", "block_bytes", "sample"), [(16, False, 1 << 20, 50), (3, True, 1 << 20, 2000), (24, False, 900, 20)])
def test_mining_against_plain_loops(spark, dims, coarse, block_bytes, sample):
    """With ties (coarse components), with several blocks of anchors, and with samples that lack positives."""
    rows = made(random.Random(dims), 400, dims, coarse=coarse)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    exact = [(r.vec_id, list(r.embedding), r.label) for r in frame.collect()]
    assert found(hard_negatives.mine(frame, block_bytes=block_bytes, sample_rows=sample)) == brute(exact)


def test_rows_that_take_no_part(spark):
    rng = random.Random(4)
    rows = made(rng, 120, 4)
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 1), (203, [float("inf"), 0.0, 0.0, 0.0], 2), (204, [0.5] * 4, None), (None, [0.5] * 4, 1)]
    rows += [(250, [0.5, 0.5], 1), (251, [0.4, 0.5], 1), (252, [0.2, 0.5], 2), (300, [], 1), (301, [], 1), (302, [], 2)]
    rows += [rows[50], rows[3], (3, [0.9] * 4, 2), (1, [9000.0] * 4, 1)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, anchor string, score int")
    assert found(hard_negatives.mine(frame)) == brute(rows[:-1])
    assert hard_negatives.mine(frame.limit(0)).isEmpty()


def test_join_gives_all_pairs_that_reach_the_threshold():
    rng = np.random.default_rng(8)
    for scale in (1, 40):
        anchors, rows = (rng.integers(-60, 60, (n, 20)) * np.linspace(scale, 1, 20).astype(int) for n in (300, 500))
        scores = anchors @ rows.T
        least = np.quantile(scores, 0.98, axis=1).astype(np.int64)
        got = {(int(i), int(j), int(s)) for x in hard_negatives.threshold_join(anchors, least, rows) for i, j, s in zip(*x, strict=True)}
        i, j = np.nonzero(scores >= least[:, None])
        assert got == {(a, b, int(scores[a, b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
