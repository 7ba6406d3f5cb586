"""Every stage of the pipeline, and run(), against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline as cp
import pytest
from provenlake.llm import byte_cnn, mixture

SPACE = r"[^\x20\x09-\x0D]+"
ITEM = "one two three four five six seven eight nine ten eleven twelve"
COLUMNS = ["doc_id", "text", "lang", "source"]


def make(n=160):
    rng = random.Random(77)
    sounds = {"en": ["the", "and", "thing", "water", "bright"], "de": ["und", "der", "schön", "wasser", "größe"], "fr": ["été", "le", "lumière", "eau", "être"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(sounds))
        words = [rng.choice(sounds[lang]) + rng.choice("aeiou") * rng.randint(0, 2) for _ in range(rng.randint(8, 120))]
        if i % 11 == 5:
            at = rng.randrange(len(words))
            words[at:at] = ITEM.split()
        if i % 13 == 7:
            words = rows[-1][1].split() if rows[-1][1] else words
        if i % 26 == 12 and rows[-1][1]:
            words = rows[-1][1].split()
            words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), None if i % 17 == 3 else lang, rng.choice(["src0", "src1", "src2", "src77", None])))
    return rows + [(900, None, "en", "src0"), (901, "", "en", "src0"), (902, "123 456 !!", None, "src1"), (903, ITEM, "en", "src1"), (904, ITEM + " and a few more", "en", "src0")]


def words(t):
    return re.findall(SPACE, t or "")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def by_language(rows, net):
    """What the network says of each text by itself."""
    out = []
    for i, t, lang, source in rows:
        if t and re.search(r"[^\W\d_]", t):
            (found,), (score,) = net.predict([t.encode()])
            if score >= cp.LEAST_SCORE:
                out.append((i, t, found, source))
    return out


def without_near_copies(rows, k=5):
    sets = []
    for _, t, *_ in rows:
        w = words(low(t))
        sets.append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for a, r in enumerate(rows):
        groups[find(a)].append(r)
    return [min(g, key=lambda r: r[0]) for g in groups.values()]


def without_benchmark(rows, items, window=10):
    out = []
    for i, t, *rest in rows:
        spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))]
        w, hit = [low(t)[a:b] for a, b in spans], set()
        for item in items:
            x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(item))
            n = min(window, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit |= set(range(b, b + n))
        if 2 * len(hit) > len(w):
            continue
        new, at, k = "", 0, 0
        while hit and k < len(w):
            if k in hit:
                new += t[at : spans[k][0]]
                while k + 1 in hit:
                    k += 1
                at = spans[k][1]
            k += 1
        out.append((i, new + t[at:] if hit else t, *rest))
    return out


def mixed(rows, epochs_most=3, seed=42):
    leaf = lambda r: (next((d for d, ms in mixture.DOMAINS.items() if r[3] in ms), "(none)" if r[3] is None else mixture.OTHER_DOMAIN), r[2] or "(none)", r[3] or "(none)")
    tokens = Counter()
    for r in rows:
        tokens[leaf(r)] += len(words(r[1]))
    given = {(): float(sum(tokens.values()))}
    for depth, weights in enumerate((mixture.DOMAIN_WEIGHTS, mixture.LANG_WEIGHTS, None)):
        below = {}
        for parent, g in given.items():
            room = Counter()
            for k, n in tokens.items():
                if k[:depth] == parent and n:
                    room[k[: depth + 1]] += n * epochs_most
            weight = {k: weights.get(k[-1], min(weights.values())) if weights else 1.0 for k in room}
            left, still = g, set(room)
            while still:
                total = sum(weight[k] for k in still)
                full = {k for k in still if room[k] <= left * weight[k] / total + 1e-9}
                for k in full or still:
                    below[k] = float(room[k]) if full else left * weight[k] / total
                left -= sum(room[k] for k in full)
                still = still - full if full else set()
        given = below
    out = []
    for k, n in tokens.items():
        budget = int(given.get(k, 0) + 1e-6)
        epochs, rest = (budget // n, budget % n) if n else (0, 0)
        run = 0
        for r in sorted((r for r in rows if leaf(r) == k), key=lambda r: hashlib.md5(f"{seed}:{epochs}:{r[0]}".encode()).hexdigest()):
            run += len(words(r[1]))
            out += [r] * (epochs + (run <= rest))
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(make(), "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "!!")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_and_run_against_brute_force(spark, tables, tmp_path):
    docs, want = spark.read.parquet(f"{tables}/documents.parquet"), make()
    net = byte_cnn.train(docs)
    plain = {"language": lambda r: by_language(r, net), "near_copies": without_near_copies, "benchmark_free": lambda r: without_benchmark(r, [ITEM]), "mix": mixed}
    for name, stage in cp.STAGES[:-1]:
        before, want = want, plain[name](want)
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns
        assert rows_of(out) == sorted(want, key=repr), name
        assert Counter(want) != Counter(before)  # its decisions take effect
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    size = lambda t: len((t or "").encode()) + 1
    for got in (cp.shard(spark, docs, tables).collect(), cp.run(spark, tables).collect()):
        assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sorted((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in want)
        places, load = defaultdict(list), Counter()
        for r in got:
            places[r.shard].append(r.slot)
            load[r.shard] += r["size"]
        assert set(places) == set(range(8)) and all(sorted(p) == list(range(len(p))) for p in places.values())
        assert max(load.values()) - min(load.values()) <= max(size(t) for _, t, *_ in want)


def test_languages_found_reach_the_mix(spark, tables):
    out = cp.language(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables)
    before = {r[0]: r[2] for r in make()}
    got = {r.doc_id: r.lang for r in out.collect()}
    assert {900, 901, 902}.isdisjoint(got) and None not in got.values()
    assert all(got[i] is not None for i, lang in before.items() if lang is None and i in got) and sum(before[i] is None for i in got) > 5
    unlabelled = spark.createDataFrame([(1, "words", None, "s"), (2, "12", None, "s")], "doc_id long, text string, lang string, source string")
    assert [(r.doc_id, r.lang) for r in cp.language(spark, unlabelled, tables).collect()] == [(1, None)]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_hard_and_empty_tables(spark, tables, hard, empty, name):
    stage = dict(cp.STAGES)[name]
    assert stage(spark, empty, tables).isEmpty()
    out = stage(spark, hard, tables)
    ids = Counter(r.doc_id for r in out.select("doc_id").collect())
    if name != "shard":
        assert out.columns == hard.columns
    if name == "language":
        assert set(ids) == {1, 5, 6, 7, None} and ids[5] == 2
    if name == "near_copies":
        assert ids == Counter({1: 1, 2: 1, 3: 1, 4: 1, 6: 1, 7: 1, 8: 1, None: 1})
    if name == "benchmark_free":
        assert ids == Counter(r.doc_id for r in hard.select("doc_id").collect())
    if name == "mix":
        assert {2, 3, 4} <= set(ids) or sum(ids.values()) > 0
    if name == "shard":
        assert ids == Counter(r.doc_id for r in hard.select("doc_id").collect())
