from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from provenlake.functions import claims as fc
from provenlake.functions import hashing, text, vectors
from provenlake.operators import approvals, chains, claims, corpus, graph, lifecycle, pins, search
from provenlake.operators.chunking import passages, tokens_in
from provenlake.sources import code, files, graphs, notes, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_numbers_and_negators(spark):
    rows = [("within seventy-two hours", [72.0]), ("30 days", [30.0]), ("thirty days", [30.0]), ("seventy days", [70.0]), ("twenty one or two", [2.0, 21.0]), ("none here", [])]
    df = spark.createDataFrame(rows, "t string, want array<double>")
    assert all(r.n == r.want for r in df.select("want", fc.read_numbers(F.col("t")).alias("n")).collect())
    pairs = [("refunds in 30 days", "refunds in 14 days", "number_conflict"), ("refunds in 30 days", "refunds in 30 days or 5", None), ("it isn’t open", "it is open", "negation_polarity"), ("no refunds", "refunds", None)]
    df = spark.createDataFrame(pairs, "a string, b string, want string")
    assert all(r.d == r.want for r in df.select("want", fc.claims_differ(F.col("a"), F.col("b")).alias("d")).collect())


def test_hash_formulas(spark):
    body = "a \u00a0b\n c\ufeff"
    want = hashlib.sha256(b"belief\na b c").hexdigest()
    assert one(spark, hashing.claim_hash(F.lit("belief"), F.lit(body))) == want
    null_title = hashlib.sha256(json.dumps([None, "b/é", "r"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
    assert one(spark, hashing.pin_hash(F.lit(None), F.lit("b/é"), F.lit("r"))) == null_title
    assert one(spark, hashing.pin_hash(F.lit(""), F.lit("b/é"), F.lit("r"))) != null_title
    assert one(spark, hashing.passage_path(F.lit("a#p1#p22"))) == "a#p1"


def test_hash_embedding_is_deterministic_and_unit(spark):
    df = spark.createDataFrame([("Refund policy",), ("",), (None,)], "t string").select(vectors.hash_embed("t").alias("v")).collect()
    assert df[2].v is None and len(df[0].v) == 256
    assert np.isclose(np.linalg.norm(df[0].v), 1)
    assert np.allclose(df[0].v, vectors.hash_vector("refund policy"))


def test_cosine_of_zero_and_lengths(spark):
    arr = lambda *xs: F.array(*[F.lit(float(x)) for x in xs])
    assert one(spark, vectors.cosine(arr(0, 0), arr(1, 0))) == 0
    assert one(spark, vectors.cosine(arr(1), arr(1, 0))) is None
    assert one(spark, vectors.cosine(arr(1, 1), arr(2, 2))) == pytest.approx(1)


def test_knn_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(60, [0.0] * 8), (61, None), (62, [1.0] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    q = df.where("doc_id < 5").select(F.col("doc_id").alias("query_id"), "vector")
    got = {(r.query_id, r["rank"]): r.doc_id for r in search.knn(q, df, k=4, min_score=-1, exclude_self=True).collect()}
    x = np.array([r[1] for r in rows[:61]])
    n = np.maximum(np.linalg.norm(x, axis=1), 1e-300)
    cos = (x @ x.T) / n[:, None] / n[None, :]
    for i in range(5):
        order = [j for j in sorted(range(61), key=lambda j: (-cos[i, j], j)) if j != i][:4]
        assert [got[i, k + 1] for k in range(4)] == order


def test_rarity_and_taper(spark):
    docs = spark.createDataFrame([(i, "common " + ("rare" if i == 7 else "other")) for i in range(60)], "doc_id long, text string")
    terms = spark.createDataFrame([(1, "rare"), (2, "common")], "query_id long, term string")
    hits = search.lexical_hits(terms, docs, "doc_id", "text", core=3, pool=12).collect()
    by = {(h.query_id, h.lex_rank): h.lexical for h in hits}
    assert by[1, 1] > 0.9 and by[2, 1] < 0.4
    assert max(h.lex_rank for h in hits) == 12
    assert by[2, 3] >= by[2, 6] >= by[2, 12] >= 0


def test_chunker_is_bounded_and_lossless():
    note = "intro line\n\n# Top\n\n" + "word " * 500 + "\n\n## Empty\n\n### Deep\n\ntext. " + "More text here. " * 60 + "\n\n```\n# not a heading\n```\n"
    got = passages(note)
    assert all(tokens_in(b) <= 220 for _, b in got)
    joined = "\n".join(b for _, b in got)
    for piece in ("intro line", "# Top", "## Empty", "### Deep", "# not a heading"):
        assert piece in joined
    assert got[-1][0] == ["Top", "Empty", "Deep"]
    assert passages("   \n ") == [] and passages("") == []
    assert all(tokens_in(b) <= 220 for _, b in passages("x" * 9000))
    assert [h for h, _ in passages("# A\n\n# B\n\nb")] == [["A"], ["B"]]


def test_frontmatter_and_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "n.md").write_text("---\ntitle: 'My note'\n---\nbody text\n")
    (tmp_path / "a" / "rule.MD").write_text("---\nplain rule\n---\nrest\n")
    (tmp_path / "skip.txt").write_text("no")
    (tmp_path / ".hidden.md").write_text("dotted")
    found = {r.path: r for r in notes.scan_notes(spark, str(tmp_path)).select("path", notes.split_frontmatter(F.col("raw")).alias("n")).collect()}
    assert set(found) == {"a/n.md", "a/rule.MD"}
    assert found["a/n.md"].n.title == "My note" and found["a/n.md"].n.body == "body text\n"
    assert found["a/rule.MD"].n.title is None and found["a/rule.MD"].n.body.startswith("---")
    (tmp_path / "loop").symlink_to(tmp_path)
    skips = {r.path: r.skip for r in notes.listing(spark, str(tmp_path)).collect()}
    assert skips["a/n.md"] is None and skips["loop"] == "symlink_cycle" and skips[".hidden.md"] == "dotted"
    listed = spark.createDataFrame([("A/x.md",), ("b/a.md",), ("c/d/e.md",)], "path string")
    assert {r.path for r in notes.exclude(listed, ["a", "c/d"]).collect()} == {"b/a.md"}
    with pytest.raises(ValueError):
        notes.exclude(listed, ["zzz"])
    with pytest.raises(ValueError):
        notes.exclude(listed, ["../up"])
    got = notes.passages_of(notes.scan_notes(spark, str(tmp_path), listed=notes.listing(spark, str(tmp_path))), "/r").collect()
    assert {r.ref for r in got} == {"a/n.md#p0", "a/rule.MD#p0"}


def test_code_chunks(spark):
    py = "import x\n\ndef f(a):\n    return a\n\nclass C:\n    def m(self):\n        pass\n\ny = 1\n"
    assert [b[:4] for b in code.blocks_of("m.py", py)] == [("function", "f", 3, 5), ("class", "C", 6, 9), ("file", "m.py", 1, 11)]
    js = "export const go = async (a) => {\n  if (a) { b(); }\n}\nclass K {\n}\n" + "// pad\n" * 400
    assert [b[:4] for b in code.blocks_of("k.ts", js)] == [("function", "go", 1, 3), ("class", "K", 4, 5)]
    df = code.code_chunks(spark.createDataFrame([("m.py", py), ("e.js", "")], "path string, source string"))
    assert df.count() == 3 and df.select("id").distinct().count() == 3


def test_small_sources(spark, tmp_path):
    g = {"documents": [{"relativePath": "a.ts", "occurrences": [{"symbol": "s", "range": [1, 2], "symbol_roles": 3}, {"symbol": "t", "range": [], "symbol_roles": 2}]}], "external_symbols": [{"symbol": "s", "displayName": "S"}], "relationships": [{"from": "s", "to": "t", "kind": "calls"}]}
    (tmp_path / "g.json").write_text(json.dumps(g))
    parts = graphs.scan_symbol_graph(spark, str(tmp_path / "g.json"))
    assert {(r.symbol, r.role) for r in parts["occurrences"].collect()} == {("s", "definition"), ("t", "reference")}
    assert parts["symbols"].first().display_name == "S" and parts["edges"].first().dst == "t"
    (tmp_path / "a.jsonl").write_text('{"seq":1,"anchorHash":"h1"}\nnot json\n\n{"seq":2,"prevAnchorHash":"h1","anchorHash":"h2"}\n')
    anchors = files.scan_anchors(spark, str(tmp_path / "a.jsonl"))
    assert [(r.line, r.entry is None) for r in anchors.orderBy("line").collect()] == [(1, False), (2, True), (4, False)]
    first = sinks.anchor({"seq": 1, "rootHash": "r1", "receipt": {"b": 1, "a": [2]}, "prevAnchorHash": None})
    second = sinks.anchor({"seq": 2, "rootHash": "r2", "anchoredAt": "now", "prevAnchorHash": first["anchorHash"]})
    edited, unlinked = second | {"rootHash": "r3"}, sinks.anchor({"seq": 3, "prevAnchorHash": "other"})
    (tmp_path / "b.jsonl").write_text("\n".join([json.dumps(first), json.dumps(second, indent=None), "{broken"]) + "\n")
    (tmp_path / "c.jsonl").write_text("\n".join(map(json.dumps, [first, edited, unlinked])) + "\n")
    judged = lambda name: [(r.ok, r.reason) for r in chains.verify_anchors(files.scan_anchors(spark, str(tmp_path / name))).orderBy("line").collect()]
    assert judged("b.jsonl") == [(True, None), (True, None), (False, "malformed")]
    assert judged("c.jsonl") == [(True, None), (False, "hash"), (False, "link")]
    (tmp_path / "m.json").write_text(json.dumps({"name": "c", "tools": [{"name": "safe", "risk": []}, {"name": "sh", "risk": ["shell"]}]}))
    tools = approvals.risky_tools(files.scan_manifest(spark, str(tmp_path / "m.json")))
    assert {r.name: r.blocked for r in tools.collect()} == {"safe": False, "sh": True}
    (tmp_path / "s.md").write_text("---\nname: brief\ntrigger: brief me|sum\n---\nDo it.\n")
    skill = files.scan_skills(spark, str(tmp_path / "s.md")).first()
    assert (skill.name, skill.trigger, skill.body) == ("brief", "brief me|sum", "Do it.\n")


def test_chain_tips_and_tampering(spark):
    rows = spark.createDataFrame([(c, s, f"p{s}") for c in (1, 2) for s in range(5)], "chain long, seq long, payload string")
    first = chains.append_chain(rows.where("seq < 3"), "chain", "seq", "payload")
    tips = first.groupBy("chain").agg(F.max_by("entry_hash", "seq").alias("tip"))
    both = first.unionByName(chains.append_chain(rows.where("seq >= 3"), "chain", "seq", "payload", tips))
    whole = chains.append_chain(rows, "chain", "seq", "payload")
    assert {tuple(r) for r in both.collect()} == {tuple(r) for r in whole.collect()}
    bad = whole.where("NOT (chain = 2 AND seq = 1)")
    got = {r.chain: (r.ok, r.checked, r.broken_at, r.reason) for r in chains.verify_chain(bad).collect()}
    assert got == {1: (True, 5, None, None), 2: (False, 1, 2, "prev_hash")}
    with pytest.raises(ValueError):
        chains.assert_chain(bad)


def test_trees_against_plain_python(spark):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def root(xs):
        while len(xs) > 1:
            xs = [h(xs[i] + (xs[i + 1] if i + 1 < len(xs) else xs[i])) for i in range(0, len(xs), 2)]
        return xs[0]

    def mountain(xs):
        peaks = {}
        for x in xs:
            k = 0
            while k in peaks:
                x, k = h(peaks.pop(k) + x), k + 1
            peaks[k] = x
        out, *rest = [peaks[k] for k in sorted(peaks)]
        for p in rest:
            out = h(out + p)
        return out

    sizes = {c: c for c in (1, 2, 3, 5, 8, 13)}
    data = {c: [h(f"{c}:{i}") for i in range(n)] for c, n in sizes.items()}
    leaves = spark.createDataFrame([(c, i, x) for c, xs in data.items() for i, x in enumerate(xs)], "chain long, idx long, hash string")
    assert {r.chain: r.root for r in chains.merkle_roots(leaves).collect()} == {c: root(xs) for c, xs in data.items()}
    assert {r.chain: r.root for r in chains.mountain_roots(leaves).collect()} == {c: mountain(xs) for c, xs in data.items()}
    stored = chains.checkpoints(leaves, 4)
    assert {r.verdict for r in chains.verify_checkpoints(stored, leaves, 4).collect()} == {"ok"}
    moved = leaves.withColumn("hash", F.when((F.col("chain") == 13) & (F.col("idx") == 5), "x").otherwise(F.col("hash")))
    assert {(r.chain, r.no) for r in chains.verify_checkpoints(stored, moved, 4).where("verdict <> 'ok'").collect()} == {(13, 1)}


def test_gate_with_payments(spark):
    rows = [(1, "h", "commit", "belief", False), (2, "h", "commit", "belief", True), (3, "h", "pay", None, None), (4, "h", "commit", "belief", True), (5, "h", "commit", "belief", False), (6, "h", "commit", "unknown", False), (7, "h", "commit", "commitment", True)]
    df = spark.createDataFrame(rows, "seq long, claim_hash string, event string, epistemic_type string, supported boolean")
    got = {r.seq: r.outcome for r in claims.commit_gate_with_payments(df).collect()}
    assert got == {1: "committed_with_debt", 2: "refused", 4: "committed", 5: "committed_with_debt", 6: "committed", 7: "refused"}


def test_revisions_and_inherited_debts(spark):
    beliefs = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "belief_id long, revision_of long")
    got = {(r.belief_id, r.ancestor) for r in claims.revision_roots(beliefs).collect()}
    assert {(2, 1), (3, 2), (3, 1), (4, 5), (5, 4)} <= got
    debts = spark.createDataFrame([(1, True, "pending")], "belief_id long, blocking boolean, status string")
    assert {r.belief_id for r in claims.inherited_debts(beliefs, beliefs, debts).collect()} == {2, 3}


def test_paraphrase_and_settling(spark):
    c = spark.createDataFrame([(1, "a", "refund in 30 days", [1.0, 0.0]), (2, "b", "other", [0.0, 1.0])], "claim_id long, claim_hash string, text string, vector array<double>")
    d = spark.createDataFrame([(9, "z", "refund in 14 days", [1.0, 0.1], "2024"), (8, "a", "same hash", [1.0, 0.0], "2023")], "debt_id long, claim_hash string, text string, vector array<double>, created_at string")
    got = [(r.claim_id, r.debt_id, r.suppressed_by) for r in claims.paraphrase_debts(c, d, 0.8).collect()]
    assert got == [(1, 9, "number_conflict")]
    assert claims.paraphrase_debts(c, d, None).isEmpty()
    from datetime import datetime, timedelta

    begin = datetime(2024, 1, 1)
    many = [(100 + i, "mine", "text", [1.0], begin + timedelta(days=50 + i)) for i in range(40)] + [(i, "other", "text", [1.0], begin + timedelta(days=i)) for i in range(40)]
    debts = spark.createDataFrame(many, "debt_id long, claim_hash string, text string, vector array<double>, created_at timestamp")
    asked = spark.createDataFrame([(1, "mine", "text", [1.0])], "claim_id long, claim_hash string, text string, vector array<double>")
    assert sorted(r.debt_id for r in claims.paraphrase_debts(asked, debts, 0.5).collect()) == list(range(8, 40))  # debts of the claim itself take no place


def test_touch_leaves_items_that_are_not_active(spark):
    items = spark.createDataFrame([(1, "active", 0, 0.5), (2, "forgotten", 3, 0.2)], "memory_id long, status string, access_count long, salience double")
    got = {r.memory_id: (r.access_count, r.salience) for r in lifecycle.touch(items, spark.createDataFrame([(1,), (1,), (2,)], "memory_id long")).collect()}
    assert got == {1: (2, 0.6), 2: (3, 0.2)}


def test_fold_knows_all_marks(spark):
    from provenlake.functions.text import index_terms

    assert one(spark, index_terms(F.lit("Čeština őrült ΆΛΦΑ e\u0301te\u0301 şehir Ñu"))) == ["cestina", "orult", "αλφα", "ete", "sehir", "nu"]


def test_passages_lose_nothing(spark):
    import random

    rng = random.Random(3)
    line = lambda: rng.choice(["", "# H", "## Sub heading " + "w" * rng.randint(1, 900), "```", "~~~~", "    # code", "word " * rng.randint(1, 300), "One. Two! Three? " * rng.randint(1, 40), "x" * rng.randint(1, 3000), "é§ñ" * rng.randint(1, 200)])
    dense = lambda t: "".join(t.split())
    for _ in range(150):
        body = "\n".join(line() for _ in range(rng.randint(0, 12)))
        got = passages(body)
        assert all(tokens_in(b) <= 220 for _, b in got)
        joined = dense("".join(b for _, b in got))
        for word in body.split():
            assert word in joined or len(word) > 200
        assert len(joined) >= len(dense(body)) and bool(got) == bool(body.strip())
    debts = spark.createDataFrame([(1, "pending"), (2, "proposed_paid"), (3, "paid"), (4, "pending")], "debt_id long, status string")
    said = spark.createDataFrame([(1, "waive", "ok"), (2, "confirm", None), (3, "waive", "x"), (4, "waive", " ")], "debt_id long, decision string, reason string")
    assert {r.debt_id: r.status for r in claims.settle_debts(debts, said).collect()} == {1: "waived", 2: "paid", 3: "paid", 4: "pending"}


def test_write_decisions_and_bucket(spark):
    w = spark.createDataFrame([(1, "pending", 10), (2, "pending", 1)], "write_id long, status string, expires_at int")
    said = spark.createDataFrame([(1, 1, "approve", 2), (1, 2, "approve", 3), (1, 3, "reject", 4), (2, 1, "approve", 5)], "write_id long, seq long, decision string, at int")
    assert {r.write_id: (r.status, r.conflicts) for r in approvals.write_states(w, said).collect()} == {1: ("approved", 1), 2: ("pending", 0)}
    times = [f"2024-01-01 00:00:{s:02d}" for s in (0, 0, 0, 0, 0, 0, 0, 0, 0, 8)]
    e = spark.createDataFrame([("u", t) for t in times], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert [r.allowed for r in lifecycle.token_bucket(e, "k", "t").orderBy("time").collect()] == [True] * 8 + [False, True]


def test_skills_graph_and_sample(spark):
    skills = spark.createDataFrame([("a", "brief|sum"), ("b", "c++ (")], "skill_id string, trigger string")
    said = spark.createDataFrame([(1, "please Brief me"), (2, "I write C++ (mostly)")], "utterance_id long, text string")
    assert {tuple(r) for r in graph.match_triggers(skills, said).collect()} == {("a", 1), ("b", 2)}
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "defines")], "src string, dst string, kind string")
    assert {(r.src, r.dst, r.hops) for r in graph.reach(edges, 3).collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}
    ids = spark.createDataFrame([("ab1",), ("ab2",), ("cd",)], "id string")
    assert [r.id for r in graph.by_prefix(ids, "id", "c").collect()] == ["cd"] and graph.by_prefix(ids, "id", "ab").isEmpty()
    rows = spark.range(100)
    got = sorted(r.id for r in pins.strided_sample(rows, F.col("id") % 50 == 0, "id", 10).collect())
    assert got[:2] == [0, 1] and len(got) == 12
    skill = spark.createDataFrame([("s", 0, False, 0, True, ["net"], ["fs"], "passed")], "skill_id string, open_holds int, has_secret boolean, stale_dependencies int, snapshot_cleared boolean, requested array<string>, manifest array<string>, faculty_status string")
    assert approvals.activation(skill).first().held_by == "capability" and approvals.activation(skill, teeth=False).first().outcome == "shadow"
    assert one(spark, text.has_credential(F.lit("key sk-abcdefghijklmnopqrstu")))
    assert corpus.oversized_files(spark.createDataFrame([("a", "x")] * 20 + [("b", "x"), ("c", "x")], "path string, body string")).first().path == "a"


def test_surface_and_workspace(spark):
    from provenlake.functions import surface

    assert one(spark, surface.outbound(F.lit("hi @Everyone <@&12>"))) == "hi `@Everyone` [role-mention]"
    assert surface.pieces("a" * 1500 + "\n" + "b" * 1500) == ["a" * 1500, "b" * 1500]
    assert [len(p) for p in surface.pieces("x" * 20000)] == [1900] * 5 and surface.pieces("") == [""]
    assert one(spark, surface.inline_safe(F.lit(" a`b\nc "))) == "a\\`b c"
    assert one(spark, surface.framed(F.lit("t"), F.lit("cli"))) == "[UNTRUSTED source=cli]\nt\n[/UNTRUSTED]"
    rows = [("k", 1, "put", "a", None), ("k", 2, "put", "b", 0), ("k", 3, "put", "b", 1), ("k", 4, "lock", "a", None), ("k", 5, "put", "b", None), ("k", 6, "unlock", "a", None), ("k", 7, "put", "b", 2)]
    df = spark.createDataFrame(rows, "key string, seq long, op string, by string, expected long")
    assert [(r.ok, r.version, r.reason) for r in approvals.workspace(df).orderBy("seq").collect()] == [(True, 1, None), (False, 1, "version"), (True, 2, None), (True, 2, None), (False, 2, "locked"), (True, 2, None), (True, 3, None)]
    q = spark.createDataFrame([(1, "!!"), (2, "w " * 40), (3, "fine")], "query_id long, text string")
    assert {(r.query_id, r.notice) for r in search.query_notices(q).collect()} == {(1, "no_terms"), (2, "truncated")}
