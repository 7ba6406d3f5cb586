from __future__ import annotations

from provenlake.llm import mixture

DOMAINS, LANGS = {"a": 0.5, "b": 0.3, "c": 0.2}, {"en": 0.4, "de": 0.2, "fr": 0.0}


def weight(name, weights):
    return weights.get(name, min(w for w in weights.values() if w > 0)) if weights else 1.0


def filled(children, given):
    """(weight, capacity) by name -> tokens: those that are full go out, one after another, the rest is dealt by weight."""
    out, open_ones = dict.fromkeys(children, 0.0), {k for k, (w, c) in children.items() if w > 0 and c > 0}
    while open_ones:
        total = sum(children[k][0] for k in open_ones)
        full = {k for k in open_ones if children[k][1] <= given * children[k][0] / total + 1e-9}
        if not full:
            return out | {k: given * children[k][0] / total for k in open_ones}
        for k in full:
            out[k] = children[k][1]
            given -= out[k]
        open_ones -= full
    return out


def brute(leaves, budget, epochs):
    ways = (DOMAINS, LANGS, None)
    room = {k: t * epochs if all(weight(x, w) > 0 for x, w in zip(k, ways)) else 0 for k, t in leaves.items()}
    given = {(): sum(leaves.values()) * budget}
    for depth, weights in enumerate(ways):
        below = {}
        for parent, tokens in given.items():
            nodes = {}
            for k, c in room.items():
                if k[:depth] == parent:
                    nodes[k[: depth + 1]] = nodes.get(k[: depth + 1], 0) + c
            below |= filled({k: (weight(k[-1], weights), c) for k, c in nodes.items()}, tokens)
        given = below
    return given


LEAVES = {
    ("a", "en", "s1"): 1000, ("a", "(none)", "s1"): 300, ("a", "ja", "s2"): 5000, ("a", "fr", "s1"): 90000, ("b", "fr", "s3"): 70000, ("b", "de", "s3"): 200,
    ("(none)", "en", "(none)"): 4000, ("(none)", "(none)", "(none)"): 100, ("c", "de", "s4"): 50000, ("c", "pt", "s4"): 10,
}


def test_budgets_against_brute_force(spark):
    df = spark.createDataFrame([(*k, t) for k, t in LEAVES.items()], "domain string, lang string, source string, tokens long")
    for budget, epochs in ((0.05, 1), (0.3, 1), (0.5, 3), (2.0, 3)):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixture.leaf_budgets(df, budget, epochs, DOMAINS, LANGS).collect()}
        want = brute(LEAVES, budget, epochs)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in got), (budget, got, want)
        room = sum(t * epochs for k, t in LEAVES.items() if k[1] != "fr")
        assert abs(sum(got.values()) - min(room, sum(LEAVES.values()) * budget)) <= len(got)


def test_rows_without_language_or_source_take_part(spark):
    rows = [(i, "five words of a text", lang, source) for i, (lang, source) in enumerate([("en", "src0"), ("en", "src1"), (None, "src0"), ("ja", "src1"), ("de", None), (None, None)] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {(r.lang, r.source) for r in mixture.mix_documents(docs, **mixture.PRODUCTION | {"budget": 1.0}).collect()}
    assert kept == {(lang, source) for _, _, lang, source in rows}
