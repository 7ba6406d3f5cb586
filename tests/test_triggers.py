"""Triggers against plain loops, and how often the utterances are read."""

from __future__ import annotations

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from provenlake.operators import graph


def _plain_triggers(skills, said):
    """How often each pair of a skill and an utterance fits; a skill is a name, or a number k that stands for the name sk."""
    said, want = list(said), Counter()
    for skill, trigger in skills:
        for utterance, text in said:
            if trigger is None or text is None:
                continue
            try:
                fits = re.search(trigger, text, re.IGNORECASE) is not None
            except re.error:
                fits = trigger.lower() in text.lower()
            want[f"s{skill}" if isinstance(skill, int) else skill, utterance] += fits
    return +want


def test_triggers_with_literals_take_one_scan_of_the_utterances(spark):
    """However many triggers there are: the utterances aren't read once for each block of them."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 3))) for _ in range(30)]
    triggers = sorted({f"{a}{s}{b}" for a, b in zip(rng.choices(words, k=40), rng.choices(words, k=40), strict=True) for s in (r"\s+", " ", ".*", "(")})
    texts = [rng.choice(["", " ", "\n"]) + rng.choice([" ", " \t", "("]).join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(50)]
    skills = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(triggers)], "skill_id string, trigger string")
    said = spark.createDataFrame(list(enumerate(texts)), "utterance_id long, text string")
    got = graph.match_triggers(skills, said, 5)
    assert Counter(map(tuple, got.collect())) == _plain_triggers(enumerate(triggers), enumerate(texts)) and got.count() > 100
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 3


def test_triggers_of_awkward_shapes(spark):
    """Those whose key says all, and those where it only seems so; letters like others, white space, long ones, ids and texts that are there twice, or null."""
    triggers = [r"kelvin\s+sun", r"\s+sun", r"sun\s+", r"a\s+\s+b", r"a\sb", r"a\s*b", r"a\s{2,}b", "a b", "(?a)kin", r"(?a:a\s+)b", "kin", "i", "(ſ", "(i̇", "[İx", "*　b", "x" * 32, "x" * 33 + "y", "y" * 40, "q\0r", r"\d", "", "(?i)SUN", "(?s:sun)", "(?<=a)b", "(?<a)b", "\U0001f600 hi", "(\U0001f600 hi", "sun|moon", "^sun"]
    texts = ["Kelvin \n ſun", "Kelvin　sun", " sun", "sun ", "sun", "\tSUN\n", "a b", "a  b", "a\nb", "ab", "a\xa0b", "KİN kin kın Kin", "i̇ (i̇", "(İ", "(ſ (s", "[i̇x [İx", "*　b * b", "x" * 70 + "y", "x" * 31, "y" * 41, "y" * 39, "q\0r", "q￿r ￿ a", "7", "", " ", "\U0001f600 hi (\U0001f600 hi", "moon", "a", "b", None]
    said = [*enumerate(texts), *enumerate(reversed(texts[:20]))] + [(None, "a b"), (None, "a b"), (5, "(?<a)b 8 sun")]
    skills = [(f"s{i}", t) for i, t in enumerate(triggers)] + [("s0", "kin"), ("s0", "kin"), (None, "sun"), ("none", None)]
    want = _plain_triggers([(k, t) for k, t in dict.fromkeys(skills)], said)
    got = graph.match_triggers(spark.createDataFrame(skills, "skill_id string, trigger string"), spark.createDataFrame(said, "utterance_id long, text string").repartition(2))
    assert Counter(map(tuple, got.collect())) == want


def test_keys_are_found_in_pieces(monkeypatch):
    """Each key once in each text, wherever a piece of the texts, of a long one, or of what was found ends."""
    monkeypatch.setattr(graph, "KEY_CHARS", 4)
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab c", k=rng.choice([*range(12), 60]))) for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100, 140), pa.int64()), pa.array(texts)], names=["utterance_id", "text"])
    keys = {"a", "b c", "abab", "ca"}
    want = Counter((k, 100 + i) for i, t in enumerate(texts) for k in keys if k in " ".join(f"|{t}|".split())[1:-1])
    for chars, places, beginnings in ((1 << 17, 1 << 20, (2, 3)), (9, 1, (1, 4)), (1, 30, (3,)), (50, 50, ()), (50, 50, (1, 2, 3, 4, 5))):
        monkeypatch.setattr(graph, "BEGINNINGS", beginnings)
        monkeypatch.setattr(graph, "CHARS_AT_ONCE", chars)
        monkeypatch.setattr(graph, "PLACES_AT_ONCE", places)
        words = next(graph._key_words(10)(iter([pa.RecordBatch.from_arrays([pa.array(sorted(keys))], names=["key"])])))
        table = np.zeros(1024, np.uint64)
        np.bitwise_or.at(table, words.column(0).to_numpy(), words.column(1).to_numpy().view(np.uint64))
        found = [row for b in graph._find_keys(SimpleNamespace(value=table), [1, 2, 3, 4])(iter([batch])) for row in b.to_pylist()]
        assert Counter((r["key"], i) for r in found for i in r["ids"] if r["key"] in keys) == want


def test_keys_by_a_full_table(spark, monkeypatch):
    """A table that takes each run of characters for a key finds the same."""
    monkeypatch.setattr(graph, "_key_table", lambda rows, n: spark.sparkContext.broadcast(np.full(1024, -1, np.int64).view(np.uint64)))
    texts = ["ship it now", "SHIP\tit", "", "nothing at all"]
    skills = [("a", r"ship\s+it"), ("b", "it now"), ("c", "(now"), ("d", r"l\s+n")]
    got = graph.match_triggers(spark.createDataFrame(skills, "skill_id string, trigger string"), spark.createDataFrame(list(enumerate(texts)), "utterance_id long, text string"))
    assert Counter(map(tuple, got.collect())) == _plain_triggers(skills, enumerate(texts)) == Counter({("a", 0): 1, ("a", 1): 1, ("b", 0): 1})
