from __future__ import annotations

import random

import corpus_pipeline


def kept_by_brute_force(rows, k=5, t=0.8):
    sets = [(i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} or {tuple(w)}) for i, w in ((i, t.split()) for i, t in rows)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if 10 * len(x & y) >= 10 * t * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least.get(find(a), i), i)
    return set(least.values())


def test_stage_takes_five_words_and_four_fifths(spark, sf_dir):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for n, edits in [(49, 1), (52, 1), (58, 1), (48, 1), (94, 2), (115, 2), (110, 3), (300, 6), (300, 20)]:
        base = [word() for _ in range(n)]
        near = list(base)
        for e in range(edits):
            near[(e + 1) * n // (edits + 1)] = word() + "x"
        texts += [" ".join(base), " ".join(near)]
    rows = list(enumerate(texts))
    want = kept_by_brute_force(rows)
    assert 9 < len(want) < 18
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir)
    assert {r.doc_id for r in kept.collect()} == want
