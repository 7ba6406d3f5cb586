from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import functions as F

from provenlake.llm import sentence_spans


def windows(text, n=51):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def shared_windows(texts):
    seen = defaultdict(set)
    for i, t in texts.items():
        for x in windows(t):
            seen[x].add(i)
    return {x: ids for x, ids in seen.items() if len(ids) > 1}


def test_no_window_of_over_50_words_repeats(spark):
    rng = random.Random(51)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))
    shapes = [[60], [51], [55, 60], [24, 27], [1, 49, 1], [30, 12, 30], [40, 15, 8], [20, 4, 30], [5] * 14, [200], [26, 26], [3, 3, 50]]
    passages = ["".join(text(n) + rng.choice([". ", "! ", "\n"]) for n in shape).strip() for shape in shapes]
    passages += [text(60), text(30) + ". " + text(10) + ". " + text(25)]  # without an end
    rows, i = [], 0
    for p in passages:
        for _ in range(3):
            before, after = rng.choice(["", text(7) + " ", text(30) + ". ", text(12) + ". " + text(9) + " "]), rng.choice(["", " " + text(8) + ".", "\n" + text(40)])
            rows.append((i, before + p + after))
            i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, text(60)), (2, rows[0][1])]
    assert len(shared_windows(dict(enumerate(t or "" for _, t in rows)))) > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sentence_spans.dedup_spans(docs, passage_words=sentence_spans.PASSAGE_WORDS).collect()
    assert len(got) == len(rows) and not shared_windows(dict(enumerate(r.text or "" for r in got)))
    for r in got:
        before = [t for i, t in rows if i == r.rec.doc_id]
        assert any(r.n_sentences == len(sentence_spans.Sentences([(t or "").encode()]).owner) and (r.text == t) == (r.n_removed == 0) for t in before)
    kept = {r.rec.doc_id: r.text for r in got}
    assert kept[0] == rows[0][1] and all(kept[3 * k] == rows[3 * k][1] for k in range(len(passages))) and kept[i + 2] == rows[i + 2][1]


def test_query_leaves_no_shared_window(spark, sf_dir):
    from provenlake.llm.queries import QUERIES

    got = {r.doc_id: r.text or "" for r in QUERIES["op7_sentence_spans"](spark, sf_dir).collect()}
    assert not shared_windows(got)


def test_a_long_sentence_in_other_words_stays(spark):
    rows = [(0, "alpha " * 2 + " ".join(f"w{k}" for k in range(60))), (1, " ".join(f"w{k}" + "x" * (k % 20 == 0) for k in range(60)))]
    got = sentence_spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)), passage_words=51)
    assert {r.rec.doc_id: r.text for r in got.collect()} == dict(rows)
