from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenlake.llm import byte_cnn, chat_snapshots, components, fragment_join, link_trust, mixture, quality_knn, sentence_spans, suffix_decontam, virtual_slots, weak_rules

SPACE = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(SPACE, t or "")


# 1


def test_quality_votes(spark, hard, empty):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["ALPHA!!", "BETA!!", "***", "$$$"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(5, 0), (6, None), (None, 1)], "doc_id long, quality int")
    voter = quality_knn.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_knn.score_quality(docs, voter).select("rec.doc_id", "score").collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i] >= 0.5) == (i % 4 > 0) for i in held)
    scored = quality_knn.score_quality(hard, voter, keep=["doc_id"]).collect()
    assert len(scored) == hard.count() and all(0 <= r.score <= 1 for r in scored)
    assert quality_knn.score_quality(empty, voter).isEmpty()
    nothing = quality_knn.train(docs, labels.limit(0))
    assert nothing is None and {r.score for r in quality_knn.score_quality(docs, nothing).collect()} == {0.5}


def test_terms_against_plain_loops():
    rng = random.Random(11)
    for n in (0, 1, 2, 5, 130):
        text = "".join(rng.choice(["ab", "Ba", "É", "!", " ", "\n", "c "]) for _ in range(n)).encode()
        counts = Counter((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) % 2**32 >> 22 for a, b, c in zip(text, text[1:], text[2:]))
        words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
        letters, spaces = sum(chr(b).isalpha() or b > 127 for b in text), sum(b in b" \t\n\v\f\r" for b in text)
        distinct = sum(len(set(words[i : i + 50])) for i in range(0, len(words), 50))
        want = [len(words), sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1), 1 - len(set(lines)) / max(len(lines), 1), distinct / max(len(words), 1),
                sum(65 <= b <= 90 for b in text) / max(letters, 1), (len(text) - letters - spaces) / max(len(text) - spaces, 1), (len(text) - spaces) / max(len(words), 1)]
        got = quality_knn.text_terms(text)
        assert {k: v for k, v in enumerate(got[: quality_knn.TERMS].tolist()) if v} == counts
        assert got[quality_knn.TERMS :].tolist() == pytest.approx(want, rel=1e-6)


def test_axes_and_levels_against_plain_ones():
    rng = np.random.default_rng(12)
    terms = np.abs(rng.integers(0, 4, (60, quality_knn.WIDTH))).astype(np.float32)
    voter = quality_knn.LatentVoter(terms, np.array([0, 1] * 30), {0: 0.5, 1: 0.5})
    x = voter.weighted(terms)
    marks = x[:, quality_knn.TERMS :].reshape(60, len(quality_knn.MARKS), quality_knn.LEVELS)
    for i in range(60):
        for k in range(len(quality_knn.MARKS)):
            value = terms[i, quality_knn.TERMS + k]
            level = sum(value >= np.quantile(terms[:, quality_knn.TERMS + k], q) for q in quality_knn.QUANTILES)
            assert marks[i, k].tolist() == pytest.approx([quality_knn.MARK_WEIGHT * (j == level) for j in range(quality_knn.LEVELS)])
    _, size, right = np.linalg.svd(x.astype(np.float64), full_matrices=False)
    lost = np.linalg.norm(x - x @ voter.axes @ voter.axes.T) ** 2
    assert lost == pytest.approx((size[quality_knn.AXES :] ** 2).sum(), rel=0.05)


def test_equal_cosines_fall_to_the_first():
    terms = np.ones((40, quality_knn.WIDTH), dtype=np.float32)
    y = np.array([0] * 20 + [1] * 20)
    voter = quality_knn.LatentVoter(terms, y, {0: 0.5, 1: 0.5}, neighbours=10)
    assert voter.score(terms[:3]).tolist() == [0.0] * 3


def test_exact_cosine_against_a_plain_loop():
    rng = np.random.default_rng(2)
    terms = np.abs(rng.integers(0, 4, (40, quality_knn.WIDTH))).astype(np.float32)
    y = np.array([0, 1] * 20)
    voter = quality_knn.LatentVoter(terms, y, {0: 0.5, 1: 0.5}, neighbours=7)
    q = np.abs(rng.integers(0, 4, (5, quality_knn.WIDTH))).astype(np.float32)
    latent = voter.weighted(q) @ voter.axes
    for row, score in zip(latent, voter.score(q), strict=True):
        cos = [float(row @ v / np.linalg.norm(row)) for v in voter.vectors]
        near = sorted(range(40), key=lambda k: -cos[k])[:7]
        w = [max(cos[k], 0) ** 4 for k in near]
        assert score == pytest.approx(sum(a * y[k] for a, k in zip(w, near, strict=True)) / sum(w), abs=1e-4)


# 2


def test_url_rules_and_hosts(spark):
    urls = [
        ("HTTPS://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/100", "example.org", "/en/100", "example.org/en/1", "block"),
        ("http://other.org/en/100", "other.org", "/en/100", "org/", "allow"),
        ("x://shop.com/de/1", "shop.com", "/de/1", "com/de/", "block"),
        ("x://shop.com/fr/1?a://b/c", "shop.com", "/fr/1", "com/fr/", "allow"),
        ("http://example.organic/es/", "example.organic", "/es/", None, "allow"),
        ("http://org", "org", "", None, "allow"),
        ("no scheme", "", "", None, "block"),
        (None, "", "", None, "block"),
        ("://", "", "", None, "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], None) for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in link_trust.judge_pages(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if rule or not host:
            assert got[i].verdict == verdict
    assert link_trust.judge_pages(pages.limit(0)).isEmpty()


def test_trust_and_distrust_spread(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    pages = spark.createDataFrame(
        [(1, "http://good.org/", link("friend.net")), (2, "http://bad.com/de/", None), (3, "http://fan.net/", link("bad.com")), (4, "http://friend.net/", ""), (5, "http://lone.net/", None)],
        "page_id long, url string, html string",
    )
    got = {r.page_id: (r.verdict, r.host_score) for r in link_trust.judge_pages(pages).collect()}
    assert got[3][0] == "block" and got[3][1] < 0 and got[4][0] == "allow" and got[4][1] > 0 and got[5] == ("allow", 0)


def test_verdicts_do_not_change_with_seeds_elsewhere(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    few = [(1, "http://good.org/", link("both.net") + link("other.net")), (2, "http://bad.com/de/", None), (3, "http://both.net/", link("bad.com")), (4, "http://far.net/", link("both.net")), (5, "http://a.both.net/", None)]
    more = few + [(100 + i, f"http://s{i}.org/", link(f"t{i}.net")) for i in range(300)] + [(500 + i, f"http://b{i}.com/de/", None) for i in range(200)]
    judged = [{r.page_id: (r.verdict, r.host_score) for r in link_trust.judge_pages(spark.createDataFrame(p, "page_id long, url string, html string")).collect()} for p in (few, more)]
    assert all(judged[1][i] == judged[0][i] for i in range(1, 6))
    assert judged[0][3][0] == "block" and judged[0][4] == ("block", -1.0) and 0 > judged[0][5][1] > -1


def test_public_suffixes_and_addresses_join_no_hosts(spark):
    urls = ["http://www.good.co.uk/", "http://evil.co.uk/", "http://10.0.0.1/", "http://10.9.0.1/", "http://www.evil.co.uk/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)] * 2, "page_id long, url string, html string")
    blocked = spark.createDataFrame([("evil.co.uk",), ("10.0.0.1",)], "host string")
    got = link_trust.judge_pages(pages, blocked=blocked).collect()
    assert len(got) == 10 and {(r.page_id, r.verdict) for r in got} == {(0, "allow"), (1, "block"), (2, "block"), (3, "allow"), (4, "block")}
    long = spark.createDataFrame([(1, "http://x.net/" + "p" * 200_000, "<p>" * 200_000 + '<a href="http://evil.com/">')], "page_id long, url string, html string")
    evil = link_trust.judge_pages(long, blocked=spark.createDataFrame([("evil.com",)], "host string")).first()
    assert evil.verdict == "block" and len(evil.path) == 200_001


def test_page_rank_against_a_plain_loop(spark):
    rng = random.Random(3)
    edges = sorted({(rng.randrange(12), rng.randrange(12)) for _ in range(40)})
    df = spark.createDataFrame([(f"h{a}", f"h{b}", 1.0) for a, b in edges], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 2.0), ("h3", 1.0), ("h4", 0.0)], "host string, seed double")
    got = {r.host: r.score for r in link_trust.propagate(seeds, df).collect()}
    home = np.zeros(12)
    home[0], home[3] = 2 / 3, 1 / 3
    m = np.zeros((12, 12))
    for a, b in edges:
        m[b, a] = 1 / sum(x == a for x, _ in edges)
    x = home
    for _ in range(link_trust.ROUNDS):
        x = 0.85 * m @ x + 0.15 * home
    assert all(got.get(f"h{i}", 0) == pytest.approx(x[i]) for i in range(12))


# 3


def test_budgets_redistribute_among_siblings_first(spark):
    leaves = spark.createDataFrame([("d1", "en", "a", 100), ("d1", "en", "b", 1000), ("d1", "de", "c", 10), ("d2", "en", "e", 5000), ("d3", "en", "f", 0)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixture.leaf_budgets(leaves, 0.2, 1, {"d1": 0.5, "d2": 0.5}).collect()}
    total = 6110 * 0.2
    # c can give only 10; the rest of d1's half goes to en, where a is full at 100 and b takes what is left.
    assert got["c"] == 10 and got["a"] == 100 and got["b"] == int(total / 2 - 110) and got["e"] == int(total / 2) and got["f"] == 0
    short = {r.source: r.budget for r in mixture.leaf_budgets(leaves, 0.9, 1, {"d1": 0.5, "d2": 0.5}).collect()}
    assert short["a"] + short["b"] + short["c"] == 1110 and short["e"] == int(6110 * 0.9 - 1110)


def test_no_budget_is_lost_beside_children_without_weight(spark):
    leaves = spark.createDataFrame([("d1", "en", "a", 10), ("d1", "it", "a", 1000), ("d2", "en", "b", 1000)], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.budget for r in mixture.leaf_budgets(leaves, 0.5, 1, {"d1": 0.5, "d2": 0.5}, {"en": 1.0, "it": 0.0}).collect()}
    assert got == {("d1", "en"): 10, ("d1", "it"): 0, ("d2", "en"): 995}


def test_mixture_prefix_and_epochs(spark, hard, empty):
    rows = [(i, "w " * (i % 7 + 1), "en", "s") for i in range(200)] + [(7, "w " * 3, "en", "s")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [(r.rec.doc_id, r.n_tokens, r.copies) for r in mixture.mixed(docs, budget=1.7, max_epochs=3, domain=F.lit("d")).collect()]
    total = sum(n for _, n, _ in got)
    budget = int(total * 1.7)
    key = lambda i: hashlib.md5(f"42:1:{i}".encode()).hexdigest()
    sums = defaultdict(int)
    for i, n, _ in got:
        sums[key(i)] += n
    upto, run = {}, 0
    for k in sorted(sums):
        run += sums[k]
        upto[k] = run
    assert all(c == 1 + (upto[key(i)] <= budget - total) for i, _, c in got)
    salted = mixture.mixed(docs, budget=1.7, max_epochs=3, domain=F.lit("d"), broadcast_leaves=0).collect()
    assert sorted((r.rec.doc_id, r.copies) for r in salted) == sorted((i, c) for i, _, c in got)
    assert mixture.mixed(hard, keep=["doc_id"]).count() == hard.count()
    assert mixture.mix_documents(hard, budget=3.0, max_epochs=3, domain_weights=None).columns == hard.columns
    assert mixture.mixed(empty).isEmpty()
    assert mixture.mixed(hard, budget=0.0).where("copies > 0 AND n_tokens > 0").isEmpty()


# 4


def test_shards(spark, hard, empty):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(5000 + i, "same text") for i in range(1500)]
    got = virtual_slots.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = dict(rows)
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    strange = virtual_slots.shard_documents(hard).collect()
    assert len(strange) == hard.count() and {r.size for r in strange if r.doc_id == 2} == {1}
    assert virtual_slots.shard_documents(empty).isEmpty()


def test_slot_map_versions(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t" * (i % 90)) for i in range(4000)], "doc_id long, text string")
    path = str(tmp_path / "map")
    virtual_slots.save_slot_map(virtual_slots.even_slot_map(spark, 8), path)
    first = {r.doc_id: r for r in virtual_slots.shard_documents(docs, 8, map_path=path).collect()}
    assert {r.map_version for r in first.values()} == {2}
    grown = {r.doc_id: r for r in virtual_slots.shard_documents(docs, 9, map_path=path).collect()}
    assert {r.map_version for r in grown.values()} == {3} and {r.shard for r in grown.values()} == set(range(9))
    load = Counter()
    for r in grown.values():
        load[r.shard] += r.size
    assert max(load.values()) < 1.02 * min(load.values())
    total = sum(r.size for r in first.values())
    assert sum(r.size for i, r in first.items() if r.shard != grown[i].shard) < 0.15 * total
    assert all(grown[i].virtual_slot == r.virtual_slot for i, r in first.items())
    even = {r.virtual_slot: r.shard for r in virtual_slots.load_slot_map(spark, path, 1).collect()}
    assert len(even) == virtual_slots.N_SLOTS and set(Counter(even.values()).values()) == {virtual_slots.N_SLOTS // 8}
    assert {r.version for r in virtual_slots.load_slot_map(spark, path).collect()} == {3}
    fewer = virtual_slots.rebalance_slot_map(virtual_slots.load_slot_map(spark, path), 7).collect()
    assert {r.shard for r in fewer} == set(range(7)) and {r.version for r in fewer} == {4} and len(fewer) == virtual_slots.N_SLOTS
    # New records in a slot that held none find a shard, too.
    more = docs.unionByName(spark.createDataFrame([(9000 + i, "u") for i in range(2000)], "doc_id long, text string"))
    assert virtual_slots.shard_documents(more, 9, map_path=path).where("shard IS NULL OR map_version <> 4").isEmpty()


def test_one_of_two_writers_publishes_a_version(spark, tmp_path):
    path = str(tmp_path / "map")
    virtual_slots.save_slot_map(virtual_slots.even_slot_map(spark, 8), path)
    loads = spark.range(virtual_slots.N_SLOTS).select(F.col("id").cast("int").alias("virtual_slot"), F.lit(1).cast("long").alias("bytes"))
    one, other = (virtual_slots.rebalance_slot_map(virtual_slots.load_slot_map(spark, path), n, loads) for n in (9, 10))
    virtual_slots.save_slot_map(one, path)
    with pytest.raises(virtual_slots.SlotMapConflict):
        virtual_slots.save_slot_map(other, path)
    assert virtual_slots.load_slot_map(spark, path).agg(F.max("shard")).first()[0] == 8
    # A writer that died after its claim holds the name until it is given back.
    virtual_slots._claim(spark, path, 3)
    with pytest.raises(virtual_slots.SlotMapConflict):
        virtual_slots.save_slot_map(virtual_slots.rebalance_slot_map(virtual_slots.load_slot_map(spark, path), 10), path)
    virtual_slots.release_claim(spark, path, 3)
    virtual_slots.save_slot_map(virtual_slots.rebalance_slot_map(virtual_slots.load_slot_map(spark, path), 10), path)
    twice = virtual_slots.load_slot_map(spark, path)
    twice.drop("version").write.mode("append").parquet(f"{path}/version=3")
    with pytest.raises(virtual_slots.SlotMapConflict):
        virtual_slots.load_slot_map(spark, path)


# 5


def brute_contamination(text, items, window=10):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = norm(text), set(), set()
    for i, t in items:
        x = norm(t)
        n = min(window, len(x))
        for a in range(len(x) - n + 1 if n else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == x[a : a + n]:
                    hit |= set(range(b, b + n))
                    found.add(i)
    return len(w), len(hit), found


@pytest.mark.parametrize("part_words", [400_000, 30])
def test_contamination_against_brute_force(spark, part_words):
    rng = random.Random(5)
    vocab = ["ab", "ba", "Aa", "é1", "x", "0", "ß"]
    text = lambda n: " ".join(rng.choice(vocab[:3] if rng.random() < 0.5 else vocab) + rng.choice(["", ",", "\n"]) for _ in range(n))
    items = [(i, text(rng.randint(0, 25))) for i in range(25)] + [(3, text(12)), (99, None), (100, "x ab"), (101, "!!")]
    docs = [(i, text(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "") + " " + text(5)) for i in range(120)] + [(500, None), (501, ""), (502, "x AB")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = suffix_decontam.find_spans(d, b, part_words=part_words).collect()
    assert len(rows) == len(docs)
    want = {i: brute_contamination(t, items) for i, t in docs}
    for r in rows:
        n, hit, found = want[r.rec.doc_id]
        assert (r.n_words, sum(s.end - s.start for s in r.spans), set(r["items"])) == (n, hit, {str(x) for x in found})


def test_removal_and_digest(spark, hard, empty):
    item = "One two three four five six seven eight nine ten eleven"
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Clean start of a longer text; {item}! And a clean end, which has more words than the item."), (2, item), (3, "clean"), (4, None)], "doc_id long, text string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    kept = {r.doc_id: r for r in suffix_decontam.remove_contamination(docs, b).collect()}
    assert set(kept) == {1, 3, 4} and "seven" not in kept[1].text and kept[1].text.startswith("Clean start") and kept[1].text.endswith("the item.")
    assert kept[1].n_chars == len(kept[1].text) and kept[3].text == "clean" and kept[4].text is None
    assert suffix_decontam.remove_contamination(hard, b).columns == hard.columns
    assert suffix_decontam.contamination(hard, b.limit(0)).where("contaminated").isEmpty()
    assert suffix_decontam.contamination(empty, b).isEmpty()
    one = suffix_decontam.contamination(docs.where("doc_id = 2"), b).first()
    assert one.items_sha256 == hashlib.sha256(b"1").hexdigest() and one.n_items == 1 and one.contaminated


# 6


def test_language_of_held_out_texts(spark, hard, empty):
    rng = random.Random(6)
    sounds = {"xx": ["ana", "bola", "tiru", "ka"], "yy": ["strk", "zwed", "mnopf"], "zz": ["да", "нет", "они"]}
    text = lambda lang, n: " ".join(rng.choice(sounds[lang]) for _ in range(n))
    rows = [(i, text(lang, rng.randint(3, 200)), lang) for i in range(240) for lang in [list(sounds)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = byte_cnn.train(docs)
    got = {r.doc_id: r for r in byte_cnn.identify(docs, net).select("rec.doc_id", "lang_pred", "score").collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.95
    strange = byte_cnn.identify(hard, net).select("rec.doc_id", "lang_pred", "score").collect()
    assert len(strange) == hard.count() and all(0 <= r.score <= 1 for r in strange)
    und = {r.doc_id for r in strange if r.lang_pred == "und"}
    assert und == {2, 3, 4, 8}
    assert byte_cnn.identify(empty, net).isEmpty() and byte_cnn.train(empty) is None
    assert {r.lang_pred for r in byte_cnn.identify(docs, None).collect()} == {"und"}
    single = byte_cnn.train(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in byte_cnn.identify(docs.limit(3), single).collect()} == {"xx"}
    assert byte_cnn.keep_identified(hard, net).columns == hard.columns


def test_gradients_by_differences():
    rng = np.random.default_rng(6)
    net = byte_cnn.ByteCNN(["a", "b", "c"])
    for name in ("embed", "bias", "out", "out_bias"):
        was = getattr(net, name)
        setattr(net, name, was.astype(float) + rng.normal(0, 0.1, was.shape))
    net.filters = [f.astype(float) for f in net.filters]
    x, y = rng.integers(0, byte_cnn.SYMBOLS, (6, 40)).astype(np.uint8), rng.integers(0, 3, 6)
    net.training = True
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    for w, g in zip(net.weights, net._gradients(x, y), strict=True):
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(4)]:
            was = w[at]
            w[at] = was + 1e-2
            up = loss()
            w[at] = was - 1e-2
            down = loss()
            w[at] = was
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=3e-3)


def test_forward_pass_against_plain_loops():
    """Embedding, filters, maximum, softmax and the mean over a text's windows, one number after another."""
    rng = random.Random(61)
    net = byte_cnn.ByteCNN(["aa", "bb", "cc"])
    net.bias += np.linspace(-0.2, 0.2, len(net.bias)).astype(np.float32)
    texts = ["".join(rng.choice("abc dé1!ñ") for _ in range(n)).encode() for n in (1, 5, 300, 1200)]

    def of_window(symbols):
        top = []
        for f in net.filters:
            w = len(f)
            for c in range(byte_cnn.FILTERS):
                top.append(max(sum(float(net.embed[symbols[p + j]][e]) * float(f[j][e][c]) for j in range(w) for e in range(byte_cnn.EMBED)) for p in range(len(symbols) - w + 1)))
        h = [max(t + float(b), 0.0) for t, b in zip(top, net.bias, strict=True)]
        z = [sum(x * float(net.out[k][c]) for k, x in enumerate(h)) + float(net.out_bias[c]) for c in range(3)]
        z = [np.exp(x - max(z)) for x in z]
        return [x / sum(z) for x in z]

    langs, scores = net.predict(texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        step, sums = byte_cnn.LENGTH - max(byte_cnn.WIDTHS) + 1, [0.0] * 3
        a = 0
        while True:
            part = [byte_cnn._symbol(b) for b in text[a : a + byte_cnn.LENGTH]]
            part += [0] * (byte_cnn.LENGTH - len(part))
            letters = sum(s >= 4 for s in part) + 1e-3
            sums = [s + letters * p for s, p in zip(sums, of_window(part), strict=True)]
            a += step
            if a >= len(text) - max(byte_cnn.WIDTHS) + 1:
                break
        share = [s / sum(sums) for s in sums]
        assert score == pytest.approx(max(share), abs=1e-4) and lang == net.langs[share.index(max(share))]


def test_no_language_is_left_out_of_the_sample(spark):
    rows = [(i, f"text {i}", f"l{i % 60:02d}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from provenlake.llm._base import hash_sample

    few, counts = hash_sample(docs, "lang", "doc_id", 300, 30)
    assert len(counts) == 60 and Counter(Counter(r.lang for r in few.collect()).values()) == {1: 60}
    assert len(byte_cnn.train(docs, epochs=1).langs) == 60


def test_windows_cover_every_byte():
    for n in (0, 1, 3, 4, 255, 256, 257, 1000, 5000):
        data = bytes(97 + i % 26 for i in range(n))
        w = byte_cnn.windows(data)
        step = byte_cnn.LENGTH - max(byte_cnn.WIDTHS) + 1
        flat = np.concatenate([x[:step] for x in w[:-1]] + [w[-1]])
        assert (flat[:n] == byte_cnn._SYMBOL[np.frombuffer(data, dtype=np.uint8)]).all() and len(flat) >= n


# 7


def split_plainly(text):
    """Words as (start, end) and, for each, the number of its sentence."""
    words, of, n = [m.span() for m in re.finditer(SPACE, text)], [], 0
    for k, (_, end) in enumerate(words):
        of.append(n)
        if text[end - 1] in ".!?" or (k + 1 < len(words) and "\n" in text[end : words[k + 1][0]]):
            n += 1
    return words, of


def spans_by_brute_force(rows, size):
    """(id, text) -> text, sentences, sentences removed; the first occurrence is the one with the smallest id and place."""
    parts, holders = [], {}
    for i, t in rows:
        words, of = split_plainly(t or "")
        tokens = [t[a:b] for a, b in words]
        by = defaultdict(list)
        for k, s in enumerate(of):
            by[s].append(k)
        sentences = [by[s] for s in sorted(by)]
        parts.append((i, t, words, tokens, sentences))
        for a in range(len(sentences) - size + 1):
            key = tuple(tokens[sentences[a][0] : sentences[a + size - 1][-1] + 1])
            holders[key] = min(holders.get(key, (i, a)), (i, a))
    for i, t, words, tokens, sentences in parts:
        covered = set()
        for a in range(len(sentences) - size + 1):
            key = tuple(tokens[sentences[a][0] : sentences[a + size - 1][-1] + 1])
            first, place = holders[key]
            if first != i or a - place >= size:
                covered |= set(range(a, a + size))
        gone, out, at = covered, "", 0
        for s in sorted(gone):
            begin = words[sentences[s][0]][0]
            out += t[at : max(begin, at)]
            at = words[sentences[s + 1][0]][0] if s + 1 < len(sentences) else len(t)
        yield i, (None if t is None else out + t[at:]), len(sentences), len(gone)


def test_spans_against_brute_force(spark, hard, empty):
    rng = random.Random(7)
    sentence = lambda: " ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 30))) + rng.choice([".", "!", "?", "\n", "...\n\n", "é."])
    pool = [[sentence() for _ in range(rng.randint(1, 6))] for _ in range(10)]
    rows = []
    for i in range(80):
        parts = [sentence() for _ in range(rng.randint(0, 5))]
        for _ in range(rng.randint(0, 3)):
            parts[rng.randint(0, len(parts)) : 0] = rng.choice(pool)
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, None), (202, ""), (203, "one."), (204, " . ! ?\n\t"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("places", "doc", "__id", "__doc", "first")})
    for size in (1, 2, 3):
        want = sorted((i, t or "", n, g, t is None) for i, t, n, g in spans_by_brute_force(rows, size))
        got = sorted((r.rec.doc_id, r.text or "", r.n_sentences, r.n_removed, r.text is None) for r in sentence_spans.dedup_spans(docs, size=size).collect())
        assert got == want
        assert any(g for _, _, _, g, _ in want)
    cleaned = {r.rec.doc_id: r for r in sentence_spans.dedup_spans(hard, passage_words=51).collect()}
    assert len(cleaned) == hard.select("doc_id").distinct().count() and cleaned[6].n_removed == 1 and 36 <= len(cleaned[6].text.split()) <= 60 and cleaned[2].text is None
    assert sentence_spans.dedup_spans(empty, passage_words=51).isEmpty()


def test_texts_of_one_id_and_without_id_are_documents_of_their_own(spark):
    passage = " ".join(f"w{k}" for k in range(30)) + ". " + " ".join(f"v{k}" for k in range(30)) + ". And a third."
    rows = [(1, passage + " One."), (1, passage + " Two."), (None, passage + " Three."), (None, passage + " Three."), (2, passage + " Four.")]
    got = sentence_spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string"), size=3).collect()
    whole = {r.text for r in got if r.n_removed == 0}
    assert whole == {passage + " Three."} and sum(r.n_removed > 0 for r in got) == 3  # nulls come first; equal rows are one document


def test_repeats_within_a_document_and_short_sentences_go(spark):
    passage, own = "Three short ones. Stand here together. Twice at least.", "Something of its own. And more of it."
    rows = [("a", f"{passage} {own} {passage}"), ("b", f"{passage} Nothing else."), ("c", own)]
    got = {r.rec.doc_id: r.text for r in sentence_spans.dedup_spans(spark.createDataFrame(rows, "doc_id string, text string"), size=3).collect()}
    assert got == {"a": f"{passage} {own} ", "b": "Nothing else.", "c": own}


def test_long_passage_goes_from_all_but_the_first(spark):
    passage = "This is the first long sentence of a passage that many documents share without any change at all. " "Here comes the second one with a good many words to make it long enough for the test. And a third, which ends the passage after some more words."
    docs = spark.createDataFrame([(i, f"Document number {i} says something of its own. {passage} Then it goes on as number {i}.") for i in range(6)], "doc_id long, text string")
    got = {r.rec.doc_id: r.text for r in sentence_spans.dedup_spans(docs, size=3).collect()}
    assert passage in got[0] and all("passage" not in got[i] and f"number {i}" in got[i] for i in range(1, 6))


# 8


def test_rule_counts_against_brute_force(spark, hard, empty):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a", "b", "c", "é", "#", "<"]) + rng.choice([" ", " ", "\n", "\t", "\u00a0"]) for _ in range(rng.randint(0, 120)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "x " * 500), (103, "l1\n\nl1\n \nl2\nl1")]
    got = {r.doc_id: r for r in weak_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w, hit = words(t), set()
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        times = Counter(win)
        for k, x in enumerate(win):
            hit |= set(range(k, k + 5)) if times[x] > 1 else set()
        lines = [x for x in (t or "").split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert not (r.base_failed and r.kept)
    assert weak_rules.judge_documents(hard).count() == hard.count() and weak_rules.judge_documents(empty).isEmpty()


def test_estimation_against_plain_python(spark):
    rng = np.random.default_rng(8)
    m = len(weak_rules.RULES)
    votes = sorted({tuple(int(v) for v in rng.choice([-1, 0, 1], m, p=[0.1, 0.2, 0.7])) for _ in range(40)})
    n = rng.integers(1, 50, len(votes)).astype(float)
    df = spark.createDataFrame([(list(v), int(k)) for v, k in zip(votes, n, strict=True)], "votes array<int>, n long")
    got = {tuple(r.votes): r.posterior for r in weak_rules.estimate(df).collect()}
    v = np.array(votes)
    q = np.where((v == -1).any(axis=1), 0.001, 0.999)
    for _ in range(weak_rules.ROUNDS):
        odds = np.log((n @ q + 1) / (n @ (1 - q) + 1)) * np.ones(len(v))
        for sign, weight in ((1, n * q), (-1, n * (1 - q))):
            for j in range(m):
                bad, ok = weight[v[:, j] == -1].sum() + 1, weight[v[:, j] == 1].sum() + 1
                odds += sign * np.select([v[:, j] == -1, v[:, j] == 1], [np.log(bad / (bad + ok)), np.log(ok / (bad + ok))], 0.0)
        q = 1 / (1 + np.exp(-odds))
    assert all(got[tuple(x)] == pytest.approx(p, abs=1e-9) for x, p in zip(votes, q, strict=True))


# 9


def brute_components(rows, t=Fraction(9, 10)):
    sets = []
    for i, text in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= t * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(least[find(a)], i)
    return {(i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets)}


def near_copies():
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]

    def edit(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = rng.choice(vocab) + "x"
        return w

    base = text(148)
    docs = [edit(base, rng.randint(0, 6)) for _ in range(300)]  # a large group, most pairs of which don't link
    for n in (8, 9, 10, 11, 12, 15, 20, 30, 50, 90, 200, 700, 3000):
        w = text(n)
        docs += [w, w + text(1)] + [edit(w, k * max(n // 100, 1)) for k in (1, 1, 2, 3, 5)]
    line = text(12)
    docs += [line + text(rng.randint(1, 14)) for _ in range(150)]  # short texts with a common line
    out = [" ".join(w) for w in docs] + [None, "", "  ", "a", "a", "A b", "a b", "a b c", "A  B c"]
    return list(enumerate(out))


def test_components_against_brute_force(spark):
    rows = near_copies()
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").withColumn("node", F.lit("clash"))
    got = {tuple(r) for r in fragment_join.jaccard_components(df).collect()}
    assert got == brute_components(rows)
    kept = {r.doc_id for r in fragment_join.deduplicate(df).collect()}
    assert kept == {i for i, _, c in got if i == c}


def test_other_thresholds_and_hard_rows(spark, hard, empty):
    rows = [r for r in near_copies() if r[0] % 3 == 0]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in fragment_join.jaccard_components(df, Fraction(8, 10)).collect()} == brute_components(rows, Fraction(8, 10))
    got = [(r.doc_id, r.component_id) for r in fragment_join.jaccard_components(hard).collect()]
    assert len(got) == hard.count() and (5, 1) in got and (2, 2) in got and (4, 4) in got and (None, None) in got
    assert fragment_join.jaccard_components(empty).isEmpty() and fragment_join.deduplicate(hard).columns == hard.columns


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other words than those"), (2, "a b c d"), (3, None), (3, None), (None, "no id here"), (None, "a b c d")]
    kept = fragment_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("__n", F.lit("clash"))).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "no id here"), (1, "a b c d"), (1, "other words than those"), (3, "")]


def test_prefixes_meet_and_signatures_allow_every_link():
    rng = np.random.default_rng(91)
    common = (np.sort(rng.integers(0, 2**63, 50, dtype=np.uint64)), np.arange(50))
    for t in (Fraction(9, 10), Fraction(8, 10)):
        for _ in range(400):
            both = int(rng.integers(1, 120))
            only_a, only_b = (int(x) for x in rng.integers(0, max(2, both // 6), 2))
            pool = rng.permutation(np.unique(np.concatenate((rng.integers(0, 2**63, both + only_a + only_b + 5, dtype=np.uint64), common[0]))))
            a = np.sort(pool[: both + only_a])
            b = np.sort(np.concatenate((pool[:both], pool[both + only_a : both + only_a + only_b])))
            if len(a) > len(b):
                a, b = b, a
            g, sizes = np.concatenate((a, b)), np.array([len(a), len(b)])
            overlap = len(np.intersect1d(a, b))
            if overlap < t * (len(a) + len(b) - overlap):
                continue
            long, short = fragment_join.prefix_lengths(sizes, t)
            keys, place = fragment_join.first_shingles(g, sizes, common, long)
            first, second = keys[: long[0]], keys[long[0] :]
            assert len(second) == long[1] and (place[: long[0]] == np.arange(long[0])).all()
            assert set(first[: short[0]].tolist()) & set(second.tolist())
            which, keys, role = fragment_join.keys_of(g, sizes, common, t)
            shown = [dict(zip(keys[which == i].tolist(), role[which == i].tolist(), strict=True)) for i in (0, 1)]
            assert any(x % 2 and shown[1][key] // 4 == sizes[1] and (x % 4 > 1 or shown[1][key] % 4 > 1) for key, x in shown[0].items() if key in shown[1])
            sign = fragment_join.signatures(g, sizes)
            assert sum(int(x).bit_count() for x in sign[0] ^ sign[1]) <= len(a) + len(b) - 2 * overlap


def test_connected(spark):
    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (12, 11), (12, 13), (20, 20)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got[3] == 1 and got[13] == 10 and got[140] == 100 and got[549] == 500 and 20 not in got and len(got) == 3 + 4 + 41 + 50


# 10


def test_snapshots_collapse(spark):
    turns = {1: "ab", 2: "abc", 3: "abc", 4: "abd", 5: "b", 6: "xyz", 7: "x"}
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", t) for c, ts in turns.items() for k, t in enumerate(ts)]
    rows += [(8, 0, None, "a"), (9, 0, "user", None), (10, 0, "user", ""), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("idx", F.lit("clash"))
    got = {r.conv_id: r for r in chat_snapshots.render_chats(df).collect()}
    assert set(got) == {2, 4, 5, 6, 8, 9, 10, None}
    assert got[2].n_copies == 2 and got[2].n_turns == 3
    assert got[2].chat == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n"
    assert chat_snapshots.render_chats(df.limit(0)).isEmpty()
    same = spark.createDataFrame([(1, 0, "user", "a")] * 2 + [(2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in chat_snapshots.render_chats(same).collect()} == {1}


def test_snapshots_with_hard_rows(spark):
    rows = [(None, 0, "user", "x")] * 3 + [(None, 5, "user", "x"), (None, 0, None, None), (None, 0, "user", "lone")] + [(1, 0, "user", "x"), (1, 1, "assistant", "y")]
    rows += [(2, None, "user", "a"), (2, None, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "b"), (4, 0, "user", "long " * 60_000), (5, 0, "user", ""), (5, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("p1", "n_copies", "h1", "last", "key", "turns")})
    got = chat_snapshots.render_chats(df).collect()
    alone = {r.chat: r for r in got if r.conv_id is None}
    assert set(alone) == {"<|user|>\nlone<|end|>\n", "<||>\n<|end|>\n"} and all(r.n_turns == 1 and r.n_copies == 1 for r in alone.values())  # x is a prefix of 1
    named = {r.conv_id: r for r in got if r.conv_id is not None}
    assert set(named) == {1, 2, 4, 5} and named[2].n_copies == 2 and named[5].n_turns == 2 and len(named[4].chat) > 300_000
    same = spark.createDataFrame([(None, 0, "user", "x")] * 4 + [(9, 3, "user", "x")], "conv_id long, turn long, role string, text string")
    one = chat_snapshots.render_chats(same).collect()
    assert [(r.conv_id, r.n_copies) for r in one] == [(9, 5)]
