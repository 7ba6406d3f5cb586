from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from provenlake.llm import hamming_join
from provenlake.llm._shingles import shingle_sets


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, threshold=Fraction(85, 100), k=5):
    """(id, number of shingles, smallest id of the component) of each row, by all pairs."""
    sets, of = [shingles(t, k) for _, t in rows], list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and Fraction(both, len(a | sets[j])) >= threshold:
                of[root(i)] = root(j)
    least = {}
    for i, (id, _) in enumerate(rows):
        r = root(i)
        least[r] = min(x for x in (least.get(r), id) if x is not None) if (least.get(r), id) != (None, None) else None
    return sorted(((id, len(sets[i]), least[root(i)]) for i, (id, _) in enumerate(rows)), key=str)


def corpus(rng, n, words=30):
    """Texts and copies with some words changed: near the threshold, above and below it."""
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120, words]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("  ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(texts)
    return texts[:n]


def found(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rows = list(enumerate(corpus(random.Random(seed), 160)))
    got = hamming_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found(got) == brute(rows)


def test_large_groups(spark, monkeypatch):
    """Documents that share a long passage meet in groups beyond the bound; chains of edits make components of many steps."""
    monkeypatch.setattr(hamming_join, "SMALL_GROUP", 4)
    monkeypatch.setattr(hamming_join.fragment_join, "SMALL_GROUP", 4)
    monkeypatch.setattr(hamming_join.fragment_join, "BLOCK_NODES", 5)
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(3000)}"
    passage = [word() for _ in range(80)]
    texts = [" ".join(passage + [word() for _ in range(rng.choice([4, 12, 30]))]) for _ in range(40)]
    chain = [word() for _ in range(60)]
    for i in range(25):
        chain = [*chain[:-1]] if i % 2 else [word(), *chain]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    got = hamming_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found(got) == brute(rows)


def test_hard_rows_and_empty_tables(spark, hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()]
    assert found(hamming_join.near_duplicates(hard)) == brute(rows)
    assert hamming_join.near_duplicates(empty).isEmpty()
    named = hamming_join.near_duplicates(hard.withColumn("doc_id", hard["doc_id"].cast("string")))
    assert named.schema["component_id"].dataType.simpleString() == "string" and named.count() == len(rows)
    kept = hamming_join.keep_first(hard)
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 6, 7, 8]


def test_one_of_equal_ids_goes_by_its_text(spark):
    """(5, b) is a copy of (3, b) and goes; (5, a) stays."""
    a, b = "some words of the first text here", "quite other words stand in this one"
    kept = hamming_join.keep_first(spark.createDataFrame([(3, b), (5, a), (5, b)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, b), (5, a)]


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 16, (300, hamming_join.SYMBOLS), dtype=np.uint16)
    other = one.copy()
    for row in other:
        row[rng.permutation(hamming_join.SYMBOLS)[: hamming_join.MOST_DIFFERENT]] += 1
    assert ((hamming_join.chunk_keys(one) == hamming_join.chunk_keys(other)).any(axis=1)).all()


def test_symbols_agree_as_often_as_sets_are_alike():
    rng = random.Random(9)
    differ = []
    for _ in range(40):
        base = [f"x{rng.randrange(10**6)}" for _ in range(300)]
        copy = [w if i % 37 else "y" + w for i, w in enumerate(base)]
        g, sizes = shingle_sets([" ".join(base).encode(), " ".join(copy).encode()], 5)
        a, b = hamming_join.minima(g, sizes)
        alike = len(shingles(" ".join(base)) & shingles(" ".join(copy))) / len(shingles(" ".join(base)) | shingles(" ".join(copy)))
        differ.append((a != b).mean() - (1 - alike))
    assert abs(np.mean(differ)) < 0.03
