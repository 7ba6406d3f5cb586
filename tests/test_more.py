from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from provenlake.functions import tables
from provenlake.functions.hashing import canonical_json
from provenlake.operators import claims, gate, graph, mountains, ordered, search
from provenlake.operators.chunking import split_passages


def test_order_within_keys_by_buckets(spark):
    rng = random.Random(3)
    rows = [(k, s, rng.randrange(100)) for k in ("a", "b", "c") for s in rng.sample(range(1000), 1 if k == "c" else 120)]
    df = spark.createDataFrame(rows, "k string, s long, v long")
    by = {k: sorted(r for r in rows if r[0] == k) for k in "abc"}
    got = {(r.k, r.s): r.idx for r in ordered.numbered(df, ["k"], "s", width=16).collect()}
    assert got == {(k, s): i for k, rs in by.items() for i, (_, s, _) in enumerate(rs)}
    got = {(r.k, r.s): r.before for r in ordered.with_previous(df, ["k"], "s", "v", "before", F.lit(-1), width=16).collect()}
    assert got == {(k, s): rs[i - 1][2] if i else -1 for k, rs in by.items() for i, (_, s, _) in enumerate(rs)}
    asked = [(k, u) for k in ("a", "b", "d") for u in (-5, 0, 15, 16, 500, 999, 5000)]
    got = {(r.k, r.u): r.n for r in ordered.counted_upto(df, ["k"], "s", spark.createDataFrame(asked, "k string, u long"), "u", "n", width=16).collect()}
    assert got == {(k, u): sum(s <= u for _, s, _ in by.get(k, [])) for k, u in asked}
    alone = [(i, rng.randrange(-3, 4)) for i in rng.sample(range(3000), 200)]
    got = {r.i: r.upto for r in ordered.running_before(spark.createDataFrame(alone, "i long, v int"), "i", "v", "upto", width=64).collect()}
    assert got == {i: sum(v for j, v in alone if j < i) for i, _ in alone}
    times = [(rng.choice("xy"), rng.choice([None, rng.randrange(500)]), i) for i in range(150)]
    got = {r.i: r.n for r in ordered.counted_within(spark.createDataFrame(times, "k string, t long, i int"), ["k"], F.col("t"), 60, "n").collect()}
    assert len(got) == 150 and all(got[i] == sum(k2 == k and t2 is not None and t - 60 <= t2 <= t for k2, t2, _ in times) for k, t, i in times if t is not None)


def test_ranges_by_many_appends(spark):
    """Three appends, one of them empty for a chain, give the same nodes as one; a prefix that isn't there has no root."""
    entries = spark.range(90).select((F.col("id") % 3).alias("chain"), "id", F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    none = spark.createDataFrame([], "chain long, height int, place long, hash string")
    peaks, nodes = none, none
    for part in ("seq < 7", "seq >= 7 AND seq < 50 AND chain <> 1", "(chain = 1 AND seq >= 7) OR seq >= 50"):
        new, peaks = mountains.sync(peaks, entries.where(part))
        nodes = nodes.unionByName(new)
    whole = mountains.append_leaves(none, entries)
    key = lambda df: sorted(tuple(r) for r in df.select("chain", "height", "place", "hash").collect())
    assert key(nodes) == key(whole)
    asked = spark.createDataFrame([(0, 30), (0, 31), (1, 1)], "chain long, leaf_count long")
    roots = {(r.chain, r.leaf_count): r.root for r in mountains.prefix_roots(nodes, asked).collect()}
    assert roots[0, 31] is None and roots[0, 30] and roots[1, 1] == [r.hash for r in entries.where("seq = 1").collect()][0]
    assert mountains.append_leaves(none, entries.limit(0)).isEmpty()


def test_receipts_of_empty_chains_are_fine(spark):
    receipts = spark.createDataFrame([("x", None, 0, None), ("y", 5, 3, "root")], "chain string, last_seq long, leaf_count long, root string")
    entries = spark.createDataFrame([], "chain string, seq long, hash string")
    nodes = spark.createDataFrame([], "chain string, height int, place long, hash string")
    assert {r.chain: r.verdict for r in mountains.verify_prefixes(receipts, entries, nodes).collect()} == {"x": "ok", "y": "none_left"}


def test_gate_without_a_threshold_says_so(spark):
    rows = [(1, "commit", "h1", "belief", "a", "slow", None, False), (2, "commit", "h2", "belief", "b", "slow", None, True), (3, "commit", "h3", "unknown", "c", "slow", 1, False), (4, "commit", "h1", "belief", "a", "slow", None, False)]
    events = spark.createDataFrame(rows, "seq long, event string, claim_hash string, epistemic_type string, text string, path string, revision_of long, strict boolean")
    sources = spark.createDataFrame([], "seq long, no int, kind string, ref long, pinned boolean, verified boolean, reason string")
    got = {r.seq: (r.outcome, r.reason, r.paraphrase) for r in gate.full_commit_gate(events, sources, None).collect()}
    assert got == {1: ("committed_with_debt", None, "no_candidates"), 2: ("rejected", "strict_without_sources", "skipped"), 3: ("committed", None, "not_applicable"), 4: ("rejected", "open_debt", "no_candidates")}


def test_revisions_with_cycles(spark):
    up = {1: None, 2: 1, 3: 2, 4: 3, 5: 6, 6: 7, 7: 5, 8: 7, 9: 9}
    got = {(r.belief_id, r.ancestor): r.depth for r in claims.revision_roots(spark.createDataFrame(list(up.items()), "belief_id long, revision_of long")).collect()}
    want = {}
    for b in up:
        at, seen, depth = up[b], set(), 1
        while at is not None and at not in seen and up.get(b) != b:
            seen.add(at)
            if at != b:
                want.setdefault((b, at), depth)
            at, depth = up[at], depth + 1
    assert got == want


@pytest.mark.parametrize(("pattern", "literal"), [("deploy(ment)?s? now", "deploy"), (r"\bship it\b", "ship it"), ("a|b", ""), ("[Cc]at", "at"), ("x*yes", "yes"), (r"\d+", ""), ("(group)", ""), ("(?=.*foo)bar", "bar"), ("über", "ber")])
def test_required_literals(pattern, literal):
    assert graph.required_literal(pattern) == literal


def test_triggers_against_plain_loops(spark):
    rng = random.Random(6)
    words = ["ship", "it", "now", "Kelvin", "straße", "İstanbul", "ſun", "100", "a+b", "(x"]
    triggers = ["ship it", "kelvin", "sun", "istanbul", r"\d\d", "(x", "a+b", "^now", "it.*now|ship$", "[", "STRASSE|straße", ".*", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(60)] + [None, ""]
    skills = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(triggers)] + [("none", None)], "skill_id string, trigger string")
    said = spark.createDataFrame(list(enumerate(texts)), "utterance_id long, text string")
    want = set()
    for i, t in enumerate(triggers):
        for j, text in enumerate(texts):
            if text is None:
                continue
            try:
                fits = re.search(t, text, re.IGNORECASE) is not None
            except re.error:
                fits = t.lower() in text.lower()
            want |= {(f"s{i}", j)} if fits else set()
    for block in (20_000, 3):
        assert {tuple(r) for r in graph.match_triggers(skills, said, block).collect()} == want


def test_canonical_json(spark):
    values = [{"b": [1, {"z": None, "a": "ü\n\"x\""}], "a": {"d": True, "c": []}}, [], {}, "text", 7, [[{"y": 1, "x": 2}]], {"B": 1, "a": 2, "_": 3}]
    rows = [(i, json.dumps(v, indent=rng)) for i, v in enumerate(values) for rng in (None, 3)] + [(99, "{broken"), (98, None)]
    got = spark.createDataFrame(rows, "i long, text string").select("i", canonical_json(F.col("text")).alias("c")).collect()
    for r in got:
        assert r.c == (None if r.i > 90 else json.dumps(values[r.i], sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def test_table_function_gives_the_operators_passages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables.register(spark)
    docs.createOrReplaceTempView("some_documents")
    got = spark.sql("SELECT doc_id, p.* FROM some_documents, LATERAL passages(text, true) AS p").collect()
    want = split_passages(docs, ["doc_id"], "text").select("doc_id", "ordinal", "body", "est_tokens", "headings").collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in want)
    plain = spark.sql("SELECT p.* FROM VALUES ('one. two.'), (null) AS t(text), LATERAL passages(text) AS p")
    assert plain.columns == ["ordinal", "body", "est_tokens"] and [r.body for r in plain.collect()] == ["one. two."]
    with pytest.raises(Exception, match="is a text"):
        spark.sql("SELECT * FROM passages(5)").collect()


def test_phrases_and_counts(spark):
    docs = spark.createDataFrame([(1, "Été a b a b c"), (2, "b a b"), (3, None), (4, "a a a"), (5, "a b c d " * 300)], "doc_id long, text string")
    got = {(r.doc_id, r.term): (r.tf, r.len) for r in search.postings(docs, "doc_id", "text").collect()}
    assert got[1, "ete"] == (1, 6) and got[1, "a"] == (2, 6) and got[4, "a"] == (3, 3) and got[5, "d"] == (300, 1200) and not any(d == 3 for d, _ in got)
    phrases = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "a", "a"]), (3, []), (4, ["b", "a", "b"]), (5, ["nope"])], "query_id long, terms array<string>")
    assert {tuple(r) for r in search.phrase_hits(phrases, docs, "doc_id", "text").collect()} == {(1, 1), (1, 5), (2, 4), (4, 1), (4, 2)}


def test_snippets_against_plain_loops(spark):
    from provenlake.operators import sessions

    rng = random.Random(16)
    words = ["running", "runs", "fox", "Café", "jumps", "lazy", "dogs", "over", "x", "42"]
    texts = ["", None, "one"] + ["".join(rng.choice(words) + rng.choice([" ", ", ", "\n", " -- "]) for _ in range(rng.choice([3, 16, 17, 60]))) for _ in range(30)]
    asked = [["run", "fox"], ["cafe"], ["nothing"], ["dog", "lazi", "42"]]
    rows = spark.createDataFrame([(i, j, t, w) for i, t in enumerate(texts) for j, w in enumerate(asked)], "i int, j int, text string, wanted array<string>")
    got = {(r.i, r.j): r.s for r in rows.select("i", "j", sessions.snippet(F.col("text"), sessions.stem_all(search.index_terms(F.col("text"))), F.col("wanted")).alias("s")).collect()}
    for i, t in enumerate(texts):
        spans = [m.span() for m in re.finditer(r"[^\W_]+", t or "")]
        stems = [sessions.stem(t[a:b].lower().replace("é", "e")) for a, b in spans]
        for j, w in enumerate(asked):
            if t is None:
                assert got[i, j] in (None, "")
                continue
            starts = sorted({min(k, max(len(spans) - 16, 0)) for k, s in enumerate(stems) if s in w})
            best = max(starts, key=lambda k: (len({s for s in stems[k : k + 16] if s in w}), sum(s in w for s in stems[k : k + 16]), -k), default=0)
            want = ""
            for k in range(best, min(best + 16, len(spans))):
                a, b = spans[k]
                want += (t[spans[k - 1][1] : a] if k > best else "") + (f"[{t[a:b]}]" if stems[k] in w else t[a:b])
            want = ("…" if best else "") + want + ("…" if best + 16 < len(spans) else "")
            assert got[i, j] == want


def test_nothing_is_appended_over_a_damaged_log(tmp_path):
    from provenlake.sources import sinks

    log, receipt = tmp_path / "log", str(tmp_path / "receipt")
    one = sinks.export_checkpoint({"seq": 1}, receipt, str(log))
    two = sinks.export_checkpoint({"seq": 2}, receipt, str(log))
    assert one["prevAnchorHash"] is None and two["prevAnchorHash"] == one["anchorHash"] == json.loads(log.read_text().splitlines()[0])["anchorHash"]
    whole = log.read_text()
    for damaged in (whole + "{half", whole.splitlines()[1] + "\n", whole.replace('"seq":1', '"seq":7')):
        log.write_text(damaged)
        with pytest.raises(sinks.DamagedLog):
            sinks.export_checkpoint({"seq": 3}, receipt, str(log))
        assert log.read_text() == damaged


def test_nearest_against_plain_loops(spark, monkeypatch):
    """Ties, zero and null vectors, unequal lengths, several blocks of queries."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(search, "BLOCKS_A_SCAN", 2)
    rng = random.Random(4)
    rows = [(i, rng.choice([[float(rng.randint(-1, 1)) for _ in range(3)], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0], [2.0, 1.0]])) for i in range(90)] + [(95, None), (96, [])]
    asked = rows[::4] + [(96, [])]
    got = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in search.knn(spark.createDataFrame(asked, "query_id long, vector array<double>"), spark.createDataFrame(rows, "doc_id long, vector array<float>"), 5, -0.5, True).collect()}
    want = {}
    for q, v in asked:
        scored = []
        for d, x in rows:
            if v is None or x is None or len(x) != len(v) or d == q:
                continue
            size = (sum(a * a for a in v) * sum(a * a for a in x)) ** 0.5
            score = sum(a * b for a, b in zip(v, x, strict=True)) / size if size else 0.0
            if score >= -0.5:
                scored.append((-round(score, 9), d))
        want |= {(q, n): (d, -s) for n, (s, d) in enumerate(sorted(scored)[:5], 1)}
    assert got == want


def test_skills_become_active_once(spark):
    from provenlake.operators import registry

    skills = spark.createDataFrame([("a", "pending", "ship it", 1), ("b", "archived", "ship it", 2), ("c", "draft", None, 3), ("d", "active", "NOW", 4)], "skill_id string, status string, trigger string, more int")
    now = registry.activate_skills(skills, spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("a",)], "skill_id string"))
    assert now.columns == skills.columns and {r.skill_id: r.status for r in now.collect()} == {"a": "active", "b": "archived", "c": "active", "d": "active"}
    said = spark.createDataFrame([(1, "please ship it now"), (2, "nothing")], "utterance_id long, text string")
    assert {tuple(r) for r in registry.match_active(now, said).collect()} == {("a", 1), ("d", 1)}
