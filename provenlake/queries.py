"""The registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import claims as fc
from .functions import text as ft
from .functions.hashing import claim_hash, passage_path, pin_hash
from .operators import approvals, chains, claims, corpus, evals, graph, lifecycle, monitoring, pins, search, sessions
from .operators.chunking import split_passages
from .plans import derive
from .plans.derive import PASSAGES_SQL, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The same white space as functions.text.SPACE_CLASS, in DuckDB's notation.
_B = chr(92)
_SPACE = "[" + _B + "t-" + _B + "r " + "".join(_B + "x{" + h + "}" + (("-" + _B + "x{200A}") if h == "2000" else "") for h in ("00A0", "1680", "2000", "2028", "2029", "202F", "205F", "3000", "FEFF")) + "]"
_TERMS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}]+')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# hashes and text


@query(f"SELECT doc_id, sha256('belief' || chr(10) || regexp_replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g')) AS claim_hash FROM documents")
def claim_hash_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", claim_hash(F.lit("belief"), F.col("text")).alias("claim_hash"))


@query("SELECT doc_id, sha256(to_json([CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END, text, lang])::VARCHAR) AS pin_hash FROM documents")
def pin_hash_docs(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source"))
    return table(spark, d, "documents").select("doc_id", pin_hash(title, F.col("text"), F.col("lang")).alias("pin_hash"))


@query(f"WITH {PASSAGES_SQL} SELECT doc_id, id, regexp_replace(ref, '#p[0-9]+$', '') AS path FROM passages")
def passage_ids(spark, d):
    return derive.passages(spark, d).select("doc_id", "id", passage_path(F.col("ref")).alias("path"))


@query(f"""SELECT doc_id, CAST(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda r: CAST(ceil(length(r) / 6) AS INTEGER))) + length(regexp_replace(text, '[A-Za-z0-9]|{_SPACE}', '', 'g')) AS INTEGER) AS est_tokens,
       CAST(ceil(length(text) / 4) AS INTEGER) AS by_length FROM documents""")
def token_estimates(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", ft.estimate_tokens(t).alias("est_tokens"), ft.estimate_tokens_by_length(t).alias("by_length"))


# retrieval


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT q.query_id, e.vec_id AS doc_id, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS score FROM q, embeddings e WHERE e.vec_id <> q.query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 0.05)
    SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def knn_cosine(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return search.knn(q, e, exclude_self=True).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT term, count(DISTINCT doc_id) AS df, least(count(DISTINCT doc_id), 10000) AS df_capped FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def term_df(spark, d):
    return search.term_df(search.held_terms(table(spark, d, "documents"), "doc_id", "text"))


def _benchmark_terms(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.explode(F.slice(ft.index_terms(F.col("text")), 1, search.MOST_TERMS)).alias("term"))


_BM25 = f"""
    docs AS (SELECT doc_id, {_TERMS.format('text')} AS terms FROM documents),
    whole AS (SELECT count(*) AS n_docs, avg(len(terms)) AS avg_len FROM docs),
    post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM docs) GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    asked AS (SELECT query_id, term, count(*) AS times FROM qt GROUP BY ALL),
    w AS (SELECT a.*, d.df, n_docs, avg_len, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM asked a JOIN dfs d USING (term), whole),
    about AS (SELECT query_id, sum(idf * times) AS mass, min(least(df, 10000)) AS min_df, any_value(n_docs) AS n_docs FROM w GROUP BY query_id),
    scored AS (SELECT w.query_id, p.doc_id, -sum(idf * times * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len)))) AS bm25 FROM post p JOIN w USING (term) GROUP BY ALL),"""
_LEX = """
    pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9), doc_id) AS lex_rank FROM allowed),
    lex AS (SELECT p.query_id, p.doc_id, p.bm25, CAST(lex_rank AS INTEGER) AS lex_rank,
                   least(abs(bm25) / mass, 1.0) * CASE WHEN n_docs <= 1 OR min_df <= 0 THEN 1.0 WHEN min_df >= 10000 THEN 0.0 ELSE greatest(least(ln(n_docs / min_df) / ln(n_docs), 1.0), 0.0) END
                   * CASE WHEN lex_rank - 1 < 50 THEN 1.0 WHEN lex_rank - 1 >= 200 THEN 0.0 ELSE (200 - (lex_rank - 1)) / 150.0 END AS lexical
            FROM pool p JOIN about USING (query_id) WHERE lex_rank <= 200)"""


@query(f"""WITH qt AS (SELECT item_id AS query_id, unnest(list_slice({_TERMS.format('text')}, 1, {search.MOST_TERMS})) AS term FROM benchmark), {_BM25}
    allowed AS (SELECT * FROM scored), {_LEX}
    SELECT query_id, doc_id, round(bm25, 6) AS bm25, lex_rank, round(lexical, 6) AS lexical FROM lex""")
def bm25_topk(spark, d):
    hits = search.lexical_hits(_benchmark_terms(spark, d), table(spark, d, "documents"), "doc_id", "text")
    return hits.select("query_id", "doc_id", F.round("bm25", 6).alias("bm25"), "lex_rank", F.round("lexical", 6).alias("lexical"))


@query(f"""WITH emb AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v FROM embeddings),
    q AS (SELECT doc_id AS query_id, v FROM emb WHERE doc_id % 50 = 0),
    qt AS (SELECT doc_id AS query_id, unnest(list_slice({_TERMS.format('text')}, 1, {search.MOST_TERMS})) AS term FROM documents WHERE doc_id % 50 = 0 AND doc_id IN (SELECT doc_id FROM emb)), {_BM25}
    allowed AS (SELECT * FROM scored WHERE doc_id IN (SELECT doc_id FROM emb)), {_LEX},
    cosines AS (SELECT query_id, doc_id, list_cosine_similarity(q.v, emb.v) AS score FROM q, emb WHERE query_id <> doc_id),
    sem AS (SELECT * FROM cosines WHERE score >= 0.05),
    l2 AS (SELECT * FROM lex WHERE query_id <> doc_id),
    both_legs AS (SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.doc_id, l.doc_id) AS doc_id, s.score AS sem, l.lexical FROM sem s FULL OUTER JOIN l2 l ON s.query_id = l.query_id AND s.doc_id = l.doc_id),
    f AS (SELECT b.query_id, b.doc_id, coalesce(b.sem, c.score, 0) AS score, coalesce(b.lexical, 0) AS lexical, 0.7 * greatest(coalesce(b.sem, c.score, 0), 0) + 0.3 * coalesce(b.lexical, 0) AS fused,
                 CASE WHEN b.sem IS NOT NULL AND b.lexical IS NOT NULL THEN 'both' WHEN b.sem IS NOT NULL THEN 'semantic' ELSE 'lexical' END AS retrieved_by
          FROM both_legs b LEFT JOIN cosines c ON b.query_id = c.query_id AND b.doc_id = c.doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, score DESC, doc_id) AS rank FROM f)
    SELECT query_id, doc_id, round(score, 6) AS score, round(lexical, 6) AS lexical, round(fused, 6) AS fused, retrieved_by, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""")
def hybrid_search(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    docs = table(spark, d, "documents")
    terms = docs.where("doc_id % 50 = 0").join(q.select(F.col("query_id").alias("doc_id")), "doc_id", "left_semi")
    terms = terms.select(F.col("doc_id").alias("query_id"), F.explode(F.slice(ft.index_terms(F.col("text")), 1, search.MOST_TERMS)).alias("term"))
    hits = search.hybrid_search(q, terms, docs, e, ["text"], exclude_self=True)
    return hits.select("query_id", "doc_id", *[F.round(c, 6).alias(c) for c in ("score", "lexical", "fused")], "retrieved_by", "rank")


@query(f"""WITH qt AS (SELECT item_id AS query_id, unnest(list_slice({_TERMS.format('text')}, 1, {search.MOST_TERMS})) AS term FROM benchmark),
    post AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents)),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    m AS (SELECT q.query_id, q.term, d.df, min(p.doc_id) AS doc_id FROM (SELECT DISTINCT * FROM qt) q JOIN dfs d USING (term) JOIN post p USING (term) WHERE d.df <= 3 AND p.doc_id % 2 = 1 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS n FROM m)
    SELECT query_id, term, doc_id FROM r WHERE n <= 2""")
def missed_matches(spark, d):
    """Every document of an even number counts as shown."""
    docs, terms = table(spark, d, "documents"), _benchmark_terms(spark, d)
    index = search.asked_postings(docs, terms, "doc_id", "text")
    shown = terms.join(index.where("doc_id % 2 = 0"), "term").select("query_id", "doc_id").distinct()
    return search.missed_matches(terms, docs, "doc_id", "text", shown)


@query(f"""WITH p AS (SELECT item_id AS query_id, {_TERMS.format('text')} AS phrase FROM benchmark WHERE len({_TERMS.format('text')}) > 0),
    d AS (SELECT doc_id, ' ' || array_to_string({_TERMS.format('text')}, ' ') || ' ' AS t FROM documents)
    SELECT query_id, doc_id FROM p, d WHERE contains(t, ' ' || array_to_string(phrase, ' ') || ' ')""")
def phrase_search(spark, d):
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), ft.index_terms(F.col("text")).alias("terms"))
    return search.phrase_hits(phrases, table(spark, d, "documents"), "doc_id", "text")


@query("SELECT 'm' || label AS model, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, model LIMIT 1")
def dominant_model(spark, d):
    return search.dominant_model(table(spark, d, "embeddings").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model")))


# corpus


@query(f"WITH {PASSAGES_SQL} SELECT split_part(path, '/', 1) AS folder, count(*) AS passages, count(DISTINCT path) AS files, CAST(sum(length(body)) AS BIGINT) AS chars FROM passages GROUP BY 1")
def corpus_stats_by_source(spark, d):
    return corpus.folder_stats(derive.passages(spark, d))


@query(f"WITH {PASSAGES_SQL}, f AS (SELECT path, count(*) AS n FROM passages GROUP BY path) SELECT list_sort(list(n))[len(list(n)) // 2 + 1] AS median_n FROM f")
def median_passages(spark, d):
    return corpus.median_passages(derive.passages(spark, d))


@query(f"""WITH {PASSAGES_SQL},
    h AS (SELECT id, ref, sha256(to_json([title, body, ref])::VARCHAR) AS h FROM passages), g AS (SELECT id, sha256(to_json([title, body, ref])::VARCHAR) AS h FROM edited),
    seen AS (SELECT DISTINCT path FROM passages WHERE doc_id % 10 < 9 OR doc_id % 3 <> 0)
    SELECT coalesce(h.id, g.id) AS id, CASE WHEN h.id IS NULL THEN 'insert' WHEN g.id IS NULL THEN CASE WHEN regexp_replace(h.ref, '#p[0-9]+$', '') IN (SELECT path FROM seen) THEN 'delete' ELSE 'keep' END WHEN h.h = g.h THEN 'keep' ELSE 'update' END AS action
    FROM h FULL OUTER JOIN g ON h.id = g.id""")
def ingest_diff(spark, d):
    p = derive.passages(spark, d)
    scanned = p.where("doc_id % 10 < 9 OR doc_id % 3 <> 0").select("path", "ingest_root", F.lit(False).alias("blank")).distinct()
    return corpus.ingest_diff(derive.with_hash(p), derive.with_hash(derive.edited(p)), scanned)


# pins


_VERIFY = f"""WITH {PASSAGES_SQL},
    now AS (SELECT id, kind, ref, title, body, ingest_root, path, sha256(to_json([title, body, ref])::VARCHAR) AS h FROM edited),
    met AS (SELECT p.*, n.h, CASE WHEN p.kind NOT IN ('vault_page') THEN 'kind_unregistered' WHEN n.h IS NULL THEN 'not_found' WHEN n.h <> p.snapshot_hash THEN 'hash_mismatch' END AS reason FROM pins p LEFT JOIN now n ON p.ref_id = n.id AND p.kind = n.kind),
    same AS (SELECT h, kind, min(id) AS same_id FROM now GROUP BY ALL),
    moved AS (SELECT m.pin_id, min(n.id) AS moved_id FROM met m JOIN now n ON m.kind = n.kind AND m.pinned_root = n.ingest_root AND regexp_replace(m.pinned_ref, '#p[0-9]+$', '') = n.path AND n.ref <> m.pinned_ref
              AND sha256(to_json([n.title, n.body, m.pinned_ref])::VARCHAR) = m.snapshot_hash WHERE m.reason IN ('not_found', 'hash_mismatch') GROUP BY 1),
    v AS (SELECT m.pin_id, m.belief_id, m.reason AS first_reason, CASE WHEN m.reason IN ('not_found', 'hash_mismatch') THEN coalesce(s.same_id, r.moved_id) END AS relocated_to
          FROM met m LEFT JOIN same s ON m.snapshot_hash = s.h AND m.kind = s.kind LEFT JOIN moved r USING (pin_id)),
    verdicts AS (SELECT pin_id, belief_id, first_reason IS NULL OR relocated_to IS NOT NULL AS verified, CASE WHEN relocated_to IS NULL THEN first_reason END AS reason, relocated_to FROM v),
    rolled AS (SELECT belief_id, count(*) AS total, CAST(sum(verified::INT) AS BIGINT) AS verified, array_to_string(list_sort(list(reason) FILTER (reason IS NOT NULL)), ',') AS failures, count(relocated_to) AS relocated FROM verdicts GROUP BY 1)"""


def _verdicts(spark, d):
    p = derive.passages(spark, d)
    return p, pins.verify_pins(derive.pins(p), derive.edited(p))


@query(_VERIFY + " SELECT * FROM verdicts")
def verify_drift(spark, d):
    return _verdicts(spark, d)[1]


@query(_VERIFY + " SELECT belief_id, total, verified, coalesce(failures, '') AS failures, relocated, CASE WHEN total = verified THEN 'sound' WHEN verified = 0 THEN 'broken' ELSE 'degraded' END AS state FROM rolled")
def verify_rollup(spark, d):
    return pins.roll_up(_verdicts(spark, d)[1]).withColumn("failures", F.array_join("failures", ","))


@query(_VERIFY + """, s AS (SELECT *, CASE WHEN total = verified THEN 'sound' WHEN verified = 0 THEN 'broken' ELSE 'degraded' END AS state FROM rolled)
    SELECT count(*) AS checked, CAST(sum((state = 'broken')::INT) AS BIGINT) AS broken, CAST(sum((state = 'degraded')::INT) AS BIGINT) AS degraded, CAST(sum(relocated) AS BIGINT) AS relocated,
           (SELECT count(DISTINCT doc_id) FROM passages WHERE doc_id NOT IN (SELECT belief_id FROM pins)) AS unsourced, sum((state <> 'sound')::INT) > 0 AS failed FROM s""")
def verify_report(spark, d):
    p, verdicts = _verdicts(spark, d)
    return pins.run_report(pins.roll_up(verdicts), derive.beliefs(p), derive.pins(p))


@query(_VERIFY + " SELECT pin_id, relocated_to FROM verdicts WHERE relocated_to IS NOT NULL")
def moved_within_file(spark, d):
    return _verdicts(spark, d)[1].where("relocated_to IS NOT NULL").select("pin_id", "relocated_to")


@query(f"WITH {PASSAGES_SQL} SELECT DISTINCT doc_id AS belief_id FROM passages WHERE doc_id NOT IN (SELECT belief_id FROM pins)")
def unsourced_beliefs(spark, d):
    p = derive.passages(spark, d)
    return pins.unsourced(derive.beliefs(p), derive.pins(p))


@query(_VERIFY + """, j AS (SELECT v.verified, (pin_id % 11 = 3 OR pin_id % 7 = 2) AS changed FROM verdicts v)
    SELECT CAST(sum((NOT verified AND changed)::INT) AS BIGINT) AS tp, CAST(sum((NOT verified AND NOT changed)::INT) AS BIGINT) AS fp, CAST(sum((verified AND changed)::INT) AS BIGINT) AS fn, CAST(sum((verified AND NOT changed)::INT) AS BIGINT) AS tn,
           round(sum((NOT verified AND changed)::INT) / sum(changed::INT), 6) AS recall, round(sum((NOT verified AND changed)::INT) / sum((NOT verified)::INT), 6) AS precision FROM j""")
def drift_confusion(spark, d):
    v = _verdicts(spark, d)[1]
    changed = (F.col("pin_id") % 11 == 3) | (F.col("pin_id") % 7 == 2)
    return evals.confusion(v, ~F.col("verified"), changed).withColumns({c: F.round(c, 6) for c in ("recall", "precision")})


# chains


def _payload():
    return F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("category"), F.lit(None).cast("string").alias("actor"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt")), {"ignoreNullFields": "false"})


def _chain(spark, d):
    e = table(spark, d, "events").withColumn("payload", _payload())
    return chains.append_chain(e, "user_id", "event_id", "payload")


_CHAIN = """WITH RECURSIVE e AS (SELECT user_id AS chain, event_id AS seq, '{"id":' || event_id || ',"category":"' || event_type || '","actor":null,"createdAt":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}' AS payload,
                            row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    c AS (SELECT chain, seq, n, payload, 'GENESIS' AS prev_hash, sha256('GENESIS' || chr(10) || payload) AS entry_hash FROM e WHERE n = 1
          UNION ALL SELECT e.chain, e.seq, e.n, e.payload, c.entry_hash, sha256(c.entry_hash || chr(10) || e.payload) FROM c JOIN e ON e.chain = c.chain AND e.n = c.n + 1)"""


@query(_CHAIN + " SELECT chain, seq, prev_hash, entry_hash FROM c")
def chain_entries(spark, d):
    return _chain(spark, d).select("chain", "seq", "prev_hash", "entry_hash")


@query(_CHAIN + """, t AS (SELECT chain, seq, n, prev_hash, entry_hash, CASE WHEN seq % 997 = 0 THEN payload || ' ' ELSE payload END AS payload FROM c),
    b AS (SELECT chain, min(n) FILTER (sha256(prev_hash || chr(10) || payload) <> entry_hash) AS bad, count(*) AS total FROM t GROUP BY chain)
    SELECT b.chain, bad IS NULL AS ok, coalesce(bad - 1, total) AS checked, t.seq AS broken_at, CASE WHEN bad IS NOT NULL THEN 'entry_hash' END AS reason FROM b LEFT JOIN t ON t.chain = b.chain AND t.n = b.bad""")
def chain_verify_tampered(spark, d):
    e = _chain(spark, d)
    return chains.verify_chain(e.withColumn("payload", F.when(F.col("seq") % 997 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))))


def _leaves(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("entry_hash"))
    return chains.leaves_of(e)


_LEAVES = """leaves AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, sha256(event_id::VARCHAR) AS hash FROM events),
    sizes AS (SELECT chain, count(*) AS n FROM leaves GROUP BY chain)"""


def _levels_sql(depth: int = 24) -> str:
    steps = [f"l0 AS (SELECT chain, idx, hash FROM leaves)"]
    for k in range(1, depth):
        steps.append(f"l{k} AS (SELECT chain, idx // 2 AS idx, CASE WHEN any_value(mx) = 0 THEN min(hash) ELSE sha256(first(hash ORDER BY idx) || last(hash ORDER BY idx)) END AS hash FROM (SELECT *, max(idx) OVER (PARTITION BY chain) AS mx FROM l{k - 1}) GROUP BY chain, idx // 2)")
    return ",\n".join(steps)


@query(f"WITH {_LEAVES}, {_levels_sql()} SELECT chain, n AS leaf_count, hash AS root FROM l23 JOIN sizes USING (chain)")
def merkle_root_by_user(spark, d):
    return chains.merkle_roots(_leaves(spark, d)).select("chain", "leaf_count", "root")


@query("""WITH RECURSIVE leaves AS (SELECT user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sha256(event_id::VARCHAR) AS hash FROM events),
    fold AS (SELECT chain, n, list_value({'h': 0, 'x': hash}) AS peaks FROM leaves WHERE n = 1
        UNION ALL SELECT f.chain, l.n, list_reduce(list_prepend(list_value({'h': 0, 'x': l.hash}), list_transform(f.peaks, lambda p: list_value(p))),
                 lambda acc, p: CASE WHEN acc[1].h = p[1].h AND len(acc) = 1 THEN list_value({'h': p[1].h + 1, 'x': sha256(p[1].x || acc[1].x)}) ELSE list_concat(acc, p) END) FROM fold f JOIN leaves l ON l.chain = f.chain AND l.n = f.n + 1),
    last AS (SELECT chain, max(n) AS n FROM leaves GROUP BY chain)
    SELECT chain, list_reduce(list_transform(peaks, lambda p: p.x), lambda a, b: sha256(a || b)) AS root, n AS leaf_count FROM fold JOIN last USING (chain, n)""")
def mountain_root_by_user(spark, d):
    return chains.mountain_roots(_leaves(spark, d))


def _tampered(proofs):
    """Every fifth leaf is exchanged, every seventh path loses a side, every eleventh root is that of something else."""
    hash = F.when(F.col("idx") % 5 == 0, F.sha2(F.concat(F.lit("x"), "hash"), 256)).otherwise(F.col("hash"))
    sides = F.when(F.col("idx") % 7 == 3, F.transform("was_right", lambda r, i: F.when(i == 0, ~r).otherwise(r))).otherwise(F.col("was_right"))
    root = F.when(F.col("idx") % 11 == 2, F.sha2(F.col("root"), 256)).otherwise(F.col("root"))
    return proofs.withColumns({"hash": hash, "was_right": sides, "root": root})


# A leaf that is paired with itself gives the same parent from either side.
_UNTOUCHED = "idx % 5 <> 0 AND idx % 11 <> 2 AND ({alone} OR idx % 7 <> 3)"


@query(f"""WITH {_LEAVES} SELECT chain, idx, {_UNTOUCHED.format(alone="n = 1 OR (idx = n - 1 AND idx % 2 = 0)")} AS ok, CAST(CASE WHEN n = 1 THEN 0 ELSE ceil(log2(n)) END AS INTEGER) AS steps FROM leaves JOIN sizes USING (chain)""")
def merkle_proof_verify(spark, d):
    leaves = _leaves(spark, d)
    proofs = _tampered(chains.prove_all(leaves))
    return proofs.select("chain", "idx", chains.verify_inclusion(F.col("hash"), F.col("siblings"), F.col("was_right"), F.col("root")).alias("ok"), F.size("siblings").alias("steps"))


@query(f"""WITH {_LEAVES.replace('event_id::VARCHAR', 'event_id::VARCHAR')}, cut AS (SELECT chain, idx // 16 AS no, idx % 16 AS idx, hash, count(*) OVER (PARTITION BY chain, idx // 16) AS n FROM leaves),
    k0 AS (SELECT chain, no, idx, hash FROM cut WHERE n = 16),
    k1 AS (SELECT chain, no, idx // 2 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM k0 GROUP BY chain, no, idx // 2),
    k2 AS (SELECT chain, no, idx // 2 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM k1 GROUP BY chain, no, idx // 2),
    k3 AS (SELECT chain, no, idx // 2 AS idx, sha256(string_agg(hash, '' ORDER BY idx)) AS hash FROM k2 GROUP BY chain, no, idx // 2),
    k4 AS (SELECT chain, no, sha256(string_agg(hash, '' ORDER BY idx)) AS root FROM k3 GROUP BY chain, no)
    SELECT chain, no, root, sha256(coalesce(lag(root) OVER (PARTITION BY chain ORDER BY no), 'GENESIS') || chr(10) || root) AS link FROM k4""")
def checkpoint_chain(spark, d):
    return chains.checkpoints(_leaves(spark, d), 16).select("chain", "no", "root", "link")


# claims


_CLAIMS = """lines AS (SELECT conv_id, turn, unnest(list_filter(list_transform(regexp_split_to_array(text, '\\n+'), lambda x: trim(regexp_replace(x, '^[-*•]\\s*', ''))), lambda x: x <> '')) AS claim FROM conversations),
    kinds AS (SELECT conv_id, turn, claim, CASE WHEN regexp_matches(claim, '(?i)\\b(i don''t know|unknown|uncertain|cannot verify|aporia|no evidence)\\b') THEN 'aporia' WHEN regexp_matches(claim, '(?i)\\b(you said|you asked|noted|acknowledged|queued|see spend)\\b') THEN 'chatter'
                     WHEN regexp_matches(claim, '(?i)\\b(is|are|was|were|will|must|always|never|fact:)\\b') AND length(claim) > 20 THEN 'assertion' ELSE 'observation' END AS kind FROM lines)"""


@query(f"WITH {_CLAIMS} SELECT conv_id, turn, kind, count(*) AS n, CAST(sum(length(claim)) AS BIGINT) AS chars FROM kinds GROUP BY ALL")
def classify_claims(spark, d):
    rows = claims.classify_claims(table(spark, d, "conversations"), ["conv_id", "turn"], "text")
    return rows.groupBy("conv_id", "turn", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("claim")).alias("chars"))


def _commits(spark, d):
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.substring(claim_hash(F.lit("belief"), F.col("text")), 1, 12).alias("claim_hash"), F.when(F.col("role") == "system", "unknown").otherwise("belief").alias("epistemic_type"), (F.length("text") % 3 != 0).alias("supported"))


@query(f"""WITH c AS (SELECT conv_id * 1000 + turn AS seq, substr(sha256('belief' || chr(10) || regexp_replace(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g'), '{_SPACE}+', ' ', 'g')), 1, 12) AS claim_hash, role <> 'system' AS bound, length(text) % 3 <> 0 AS supported FROM conversations),
    o AS (SELECT *, coalesce(sum((bound AND NOT supported)::INT) OVER (PARTITION BY claim_hash ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS blocked FROM c)
    SELECT seq, claim_hash, CASE WHEN bound AND blocked THEN 'refused' WHEN bound AND NOT supported THEN 'committed_with_debt' ELSE 'committed' END AS outcome FROM o""")
def commit_gate(spark, d):
    return claims.commit_gate(_commits(spark, d))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(translate(lower(text), '‘’', ''''''), '[a-z0-9'']+') AS t FROM benchmark)
    SELECT item_id, CAST(len(list_filter(t, lambda x: x IN ('not', 'never', 'cannot', 'none', 'neither', 'nor') OR regexp_matches(x, '.n''t$'))) AS INTEGER) AS negators FROM w""")
def negator_counts(spark, d):
    return table(spark, d, "benchmark").select("item_id", fc.count_negators(F.col("text")).alias("negators"))


@query("""WITH pr AS (SELECT vec_id, vec_id % 2 = 0 AS same, (1 + list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[]))) / 2 AS score, vec_id % 5 = 0 AS suppressed FROM embeddings),
    st AS (SELECT unnest(range(50)) AS t), pl AS (SELECT *, greatest(least(CAST(floor((score - 0.5) / 0.01 + 1e-9) AS INTEGER), 49), -1) AS place FROM pr)
    SELECT round(0.5 + t * 0.01, 2) AS threshold, CAST(sum((same AND place < t)::INT) AS BIGINT) AS fn, CAST(sum((NOT same AND place >= t)::INT) AS BIGINT) AS fp,
           CAST(sum((same AND (place < t OR suppressed))::INT) AS BIGINT) AS fn_net, CAST(sum((NOT same AND place >= t AND NOT suppressed)::INT) AS BIGINT) AS fp_net FROM st, pl GROUP BY t""")
def threshold_sweep(spark, d):
    from .functions.vectors import cosine

    e = table(spark, d, "embeddings")
    pairs = e.select((F.col("vec_id") % 2 == 0).alias("same"), ((1 + cosine(F.col("embedding"), F.reverse("embedding"))) / 2).alias("score"), (F.col("vec_id") % 5 == 0).alias("suppressed"))
    return evals.threshold_sweep(pairs)


@query("""WITH q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT q.query_id, q.label = e.label AS relevant, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.v, e.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM q, embeddings e WHERE e.vec_id <> q.query_id AND list_cosine_similarity(q.v, e.embedding::DOUBLE[]) >= 0.05),
    f AS (SELECT q.query_id, 't' || (q.label % 2) AS tier, (SELECT min(rank) FROM s WHERE s.query_id = q.query_id AND relevant AND rank <= 8) AS first FROM q)
    SELECT coalesce(tier, 'all') AS tier, count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_3, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM f GROUP BY ROLLUP (tier)""")
def retrieval_metrics(spark, d):
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    q = rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector", F.col("label").alias("q_label"))
    hits = search.knn(q, rows, exclude_self=True).join(rows.select("doc_id", "label"), "doc_id").join(q.select("query_id", "q_label"), "query_id")
    out = evals.retrieval_metrics(hits.select("query_id", "rank", (F.col("label") == F.col("q_label")).alias("relevant")), q.select("query_id", F.concat(F.lit("t"), (F.col("q_label") % 2).cast("string")).alias("tier")))
    return out.withColumns({c: F.round(c, 6) for c in ("recall_1", "recall_3", "mrr")})


@query("""WITH q AS (SELECT vec_id AS debt_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
    s AS (SELECT q.debt_id, e.vec_id AS doc_id, list_cosine_similarity(q.v, e.embedding::DOUBLE[]) AS score FROM q, embeddings e WHERE e.vec_id <> q.debt_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY debt_id ORDER BY score DESC, doc_id) AS rn FROM s WHERE score >= 0.15)
    SELECT debt_id, round(max(score), 6) AS best, string_agg(doc_id::VARCHAR, ',' ORDER BY rn) AS attached, CASE WHEN max(score) >= 0.35 THEN 'paid' ELSE 'proposed_paid' END AS status FROM r WHERE rn <= 3 GROUP BY 1""")
def propose_payment(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    hits = search.knn(q, e, k=5, min_score=0.15, exclude_self=True).withColumnRenamed("query_id", "debt_id")
    out = claims.propose_payment(hits)
    return out.select("debt_id", F.round("best", 6).alias("best"), F.array_join("attached", ",").alias("attached"), "status")


# lifecycle


def _now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


@query("""WITH r AS (SELECT event_type AS channel, count(*) AS n, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 10) AS BIGINT) AS output_tokens, CAST(sum(greatest(CAST(round(value * 1000000) AS BIGINT), 0)) AS BIGINT) AS cost_micros FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 24 HOURS GROUP BY 1)
    SELECT *, CAST(sum(cost_micros) OVER () AS BIGINT) AS total_micros, sum(cost_micros) OVER () >= 5000000 AS alert FROM r""")
def spend_by_channel(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("channel"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 10).alias("output_tokens"), ft.money_micros(F.col("value")).alias("cost_usd_micros"), F.col("ts").alias("created_at"))
    return lifecycle.spend_report(e, _now())


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def hourly_rate(spark, d):
    return lifecycle.rate_last_hour(table(spark, d, "events"), "event_type", "ts", "event_id").select("event_id", "in_hour")


@query("SELECT event_id AS belief_id, CASE WHEN event_type <> 'purchase' AND ts + INTERVAL 5 DAYS <= TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'active' END AS status FROM events")
def expire_due(spark, d):
    e = table(spark, d, "events")
    b = e.select(F.col("event_id").alias("belief_id"), F.lit("active").alias("status"), F.when(F.col("event_type") != "purchase", F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"))
    return lifecycle.expire_beliefs(b, _now())


_MEMORY = """m AS (SELECT event_id AS memory_id, CASE event_id % 4 WHEN 0 THEN 'working' WHEN 1 THEN 'episodic' WHEN 2 THEN 'semantic' ELSE 'skill_note' END AS layer, (event_id % 100) / 100.0 AS salience, ts,
                 CASE event_id % 4 WHEN 0 THEN ts + INTERVAL 6 HOURS WHEN 1 THEN ts + INTERVAL 14 DAYS END AS expires_at FROM events)"""


def _memory(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    items = e.select(F.col("event_id").alias("memory_id"), F.when(k == 0, "working").when(k == 1, "episodic").when(k == 2, "semantic").otherwise("skill_note").alias("layer"), ((F.col("event_id") % 100) / 100.0).alias("salience"), "ts", F.lit(None).cast("long").alias("half_life_seconds"), F.lit("note").alias("source"), F.lit("active").alias("status"), F.lit(0).cast("long").alias("access_count"))
    return lifecycle.remember(items, F.col("ts"))


@query(f"WITH {_MEMORY} SELECT memory_id, CASE WHEN expires_at <= TIMESTAMP '2024-01-20' THEN CASE WHEN layer NOT IN ('semantic', 'skill_note') AND salience < 0.3 THEN 'forgotten' ELSE 'decayed' END ELSE 'active' END AS status FROM m")
def memory_decay(spark, d):
    return lifecycle.decay(_memory(spark, d), _now())


@query(f"WITH {_MEMORY}, a AS (SELECT user_id AS memory_id, count(*) AS n FROM events GROUP BY 1) SELECT memory_id, coalesce(n, 0) AS access_count, round(CASE WHEN n > 0 THEN least(1.0, salience + 0.05 * n) ELSE salience END, 6) AS salience FROM m LEFT JOIN a USING (memory_id)")
def memory_touch(spark, d):
    out = lifecycle.touch(_memory(spark, d), table(spark, d, "events").select(F.col("user_id").alias("memory_id")))
    return out.withColumn("salience", F.round("salience", 6))


@query(f"""WITH {_MEMORY}, s AS (SELECT *, CASE WHEN expires_at <= TIMESTAMP '2024-01-20' THEN CASE WHEN layer NOT IN ('semantic', 'skill_note') AND salience < 0.1 THEN 'forgotten' ELSE 'decayed' END ELSE 'active' END AS status FROM m)
    (SELECT memory_id, 'promote' AS proposal FROM s WHERE layer = 'episodic' AND status = 'active' AND salience >= 0.7 ORDER BY salience DESC, memory_id LIMIT 10)
    UNION ALL (SELECT memory_id, 'forget' FROM s WHERE layer = 'working' AND status = 'decayed' AND salience < 0.2 ORDER BY memory_id LIMIT 10)""")
def dream_candidates(spark, d):
    items = _memory(spark, d)
    due = F.coalesce(F.col("expires_at") <= _now(), F.lit(False))
    low = ~F.col("layer").isin("semantic", "skill_note") & (F.col("salience") < 0.1)
    return lifecycle.dream(items.withColumn("status", F.when(due & low, "forgotten").when(due, "decayed").otherwise("active")))


@query("SELECT event_id AS job_id, CASE WHEN event_id % 7 >= 5 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN event_id % 7 >= 5 THEN ts ELSE TIMESTAMP '2024-01-20' + CAST(least(60, pow(2, least(event_id % 7, 5))) AS INTEGER) * INTERVAL 1 SECOND END AS run_after FROM events")
def job_backoff(spark, d):
    jobs = table(spark, d, "events").select(F.col("event_id").alias("job_id"), (F.col("event_id") % 7).alias("attempts"), F.lit(5).alias("max_attempts"), F.col("ts").alias("run_after"))
    return lifecycle.after_failure(jobs, _now())


@query("""SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 60 * (event_id % 9 + 1) WHEN 1 THEN 3600 * (event_id % 9 + 1) WHEN 2 THEN 86400 * (event_id % 9 + 1) ELSE 3600 END AS BIGINT) AS seconds FROM events""")
def cron_interval(spark, d):
    unit = F.element_at(F.array(F.lit("m"), F.lit("h"), F.lit("d"), F.lit("x")), (F.col("event_id") % 4 + 1).cast("int"))
    schedule = F.concat(F.lit("interval:"), (F.col("event_id") % 9 + 1).cast("string"), unit)
    return table(spark, d, "events").select("event_id", lifecycle.interval_seconds(schedule).alias("seconds"))


@query("WITH j AS (SELECT event_type AS kind, ts AS run_after, event_id AS job_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE event_id % 2 = 0 AND ts <= TIMESTAMP '2024-01-20') SELECT kind, job_id, run_after FROM j WHERE n = 1")
def next_jobs(spark, d):
    jobs = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("job_id"), F.col("ts").alias("run_after"), F.when(F.col("event_id") % 2 == 0, "pending").otherwise("done").alias("status"))
    return lifecycle.next_jobs(jobs, _now())


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' AND user_id % 2 = 0 AND ts >= TIMESTAMP '2024-01-05' ORDER BY event_id DESC LIMIT 100")
def audit_filter(spark, d):
    e = table(spark, d, "events").where((F.col("event_type") == "click") & (F.col("user_id") % 2 == 0) & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp")))
    return e.select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query("SELECT (SELECT count(*) FROM documents) AS docs, (SELECT count(*) FROM events) AS audit_events, (SELECT count(*) FROM benchmark) AS beliefs, (SELECT count(*) FROM labels WHERE quality = 0) AS open_debts")
def status_counters(spark, d):
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [n(table(spark, d, "documents"), "docs"), n(table(spark, d, "events"), "audit_events"), n(table(spark, d, "benchmark"), "beliefs"), n(table(spark, d, "labels").where("quality = 0"), "open_debts")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(parts[3])  # one row each


@query("SELECT event_type, count(*) AS events, CAST(sum((user_id % 3 = 0)::INT) AS BIGINT) AS blocked, round(avg(CASE WHEN event_id % 4 <> 0 THEN event_id % 5 END), 1) AS felt FROM events GROUP BY 1")
def pilot_summary(spark, d):
    felt = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 5)
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum((F.col("user_id") % 3 == 0).cast("int")).alias("blocked"), F.round(F.avg(felt), 1).alias("felt"))


# approvals


def _pending(spark, d):
    e = table(spark, d, "events")
    pick = lambda names, of: F.element_at(F.array(*[F.lit(x) for x in names]), (of % len(names) + 1).cast("int"))
    i = F.col("event_id")
    return e.select(i.alias("write_id"), pick(["memory", "skill", "constitution", "user_profile"], i).alias("target"), pick(["add", "create", "delete"], F.floor(i / 4)).alias("action"), pick(["foreground", "background_review", "dream"], F.floor(i / 12)).alias("origin"),
                    F.when(i % 5 == 0, None).otherwise(pick(["routine", "elevated", "consequential", "routine"], F.floor(i / 36))).alias("stakes"), F.when(i % 2 == 0, "because").alias("reason"), F.col("ts").alias("created_at"))


_PENDING = """p AS (SELECT event_id AS write_id, (['memory', 'skill', 'constitution', 'user_profile'])[event_id % 4 + 1] AS target, (['add', 'create', 'delete'])[(event_id // 4) % 3 + 1] AS action, (['foreground', 'background_review', 'dream'])[(event_id // 12) % 3 + 1] AS origin,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE (['routine', 'elevated', 'consequential', 'routine'])[(event_id // 36) % 4 + 1] END AS stakes, CASE WHEN event_id % 2 = 0 THEN 'because' END AS reason, ts FROM events),
    rules(rule_id, name, priority, target, action, origin, stakes, outcome, most) AS (VALUES """ + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in approvals.DEFAULT_RULES) + """),
    m AS (SELECT p.write_id, r.rule_id, r.outcome, r.most, p.ts, p.target, row_number() OVER (PARTITION BY p.write_id ORDER BY r.priority, r.name) AS n FROM p JOIN rules r ON (r.target IS NULL OR r.target = p.target) AND (r.action IS NULL OR r.action = p.action) AND (r.origin IS NULL OR r.origin = p.origin)
          AND (r.stakes IS NULL OR r.stakes = coalesce(p.stakes, 'routine')) AND NOT (r.rule_id = 'wf_reject_empty_reason' AND p.origin = 'background_review' AND trim(coalesce(p.reason, '')) <> ''))"""


@query(f"WITH {_PENDING} SELECT write_id, rule_id, outcome FROM m WHERE n = 1")
def workflow_match(spark, d):
    return approvals.match_rules(_pending(spark, d), approvals.default_rules(spark)).select("write_id", "rule_id", "outcome")


@query(f"""WITH {_PENDING}, c AS (SELECT *, count(*) OVER (PARTITION BY rule_id, outcome ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS k FROM m WHERE n = 1)
    SELECT write_id, rule_id, CASE WHEN outcome = 'auto_approve' AND NOT (target <> 'constitution' AND (most IS NULL OR k <= most)) THEN 'require_human' ELSE outcome END AS decision FROM c""")
def workflow_decisions(spark, d):
    return approvals.decide(_pending(spark, d), approvals.default_rules(spark))


@query("SELECT event_id AS write_id, CASE WHEN ts + INTERVAL 72 HOURS < TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'pending' END AS status FROM events")
def pending_expiry(spark, d):
    w = table(spark, d, "events").select(F.col("event_id").alias("write_id"), F.lit("pending").alias("status"), (F.col("ts") + F.expr("INTERVAL 72 HOURS")).alias("expires_at"))
    return approvals.expire_pending(w, _now())


@query("""WITH c AS (SELECT event_id AS case_id, (['routine', 'elevated', 'consequential'])[event_id % 3 + 1] AS stakes, event_id % 11 = 0 AS debts, event_id % 4 <> 0 AS has_sources, event_id % 2 = 0 AS belief, event_id % 13 = 0 AS harm, event_id % 17 = 0 AS shell, event_id % 5 = 0 AS skill, event_id % 19 = 0 AS short, event_id % 2 = 1 AS timed_out FROM events),
    v AS (SELECT *, CASE WHEN debts THEN 'reject' WHEN NOT has_sources AND belief THEN 'defer' ELSE 'approve' END AS epi, CASE WHEN harm THEN 'reject' WHEN stakes = 'consequential' THEN 'defer' ELSE 'approve' END AS eth,
                 CASE WHEN short THEN 'reject' ELSE 'approve' END AS lang, CASE WHEN skill AND stakes <> 'routine' THEN 'defer' WHEN shell THEN 'reject' ELSE 'approve' END AS tech, CASE WHEN NOT has_sources AND debts THEN 'abstain' ELSE 'approve' END AS mind FROM c),
    t AS (SELECT *, CAST(len(list_filter([epi, eth, lang, tech, mind], lambda x: x = 'approve')) AS BIGINT) AS approves, CAST(len(list_filter([epi, eth, lang, tech, mind], lambda x: x = 'reject')) AS BIGINT) AS rejects, CASE stakes WHEN 'consequential' THEN 4 WHEN 'elevated' THEN 3 ELSE 2 END AS quorum FROM v)
    SELECT case_id, approves, rejects, quorum, CASE WHEN rejects > 0 THEN 'rejected' WHEN approves >= quorum THEN 'passed' WHEN timed_out THEN CASE WHEN stakes = 'routine' AND epi = 'approve' THEN 'passed' ELSE 'parked' END ELSE 'open' END AS status FROM t""")
def vote_tally(spark, d):
    i = F.col("event_id")
    cases = table(spark, d, "events").select(
        i.alias("case_id"), F.element_at(F.array(F.lit("routine"), F.lit("elevated"), F.lit("consequential")), (i % 3 + 1).cast("int")).alias("stakes"), (i % 11 == 0).cast("int").alias("open_debts"), (i % 4 != 0).alias("has_sources"),
        F.when(i % 2 == 0, "belief").otherwise("skill").alias("subject_kind"), F.filter(F.array(F.when(i % 13 == 0, "harm"), F.when(i % 17 == 0, "shell")), lambda x: x.isNotNull()).alias("risk_tags"),
        (i % 5 == 0).alias("is_skill_mutation"), F.when(i % 19 == 0, "why?").otherwise("is this claim sound?").alias("question"), (i % 2 == 1).alias("timed_out"),
    )
    return approvals.tally(cases, approvals.faculty_votes(cases))


@query("""WITH a AS (SELECT doc_id AS name, source AS description, lang AS input_schema FROM documents WHERE doc_id % 7 <> 0), b AS (SELECT doc_id AS name, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE source END AS description, CASE WHEN doc_id % 11 = 0 THEN 'y' ELSE lang END AS input_schema FROM documents WHERE doc_id % 3 <> 0)
    SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.input_schema IS DISTINCT FROM b.input_schema THEN 'schema' WHEN a.description IS DISTINCT FROM b.description THEN 'description' ELSE 'none' END AS change FROM a FULL OUTER JOIN b ON a.name = b.name""")
def catalogue_diff(spark, d):
    docs = table(spark, d, "documents")
    i = F.col("doc_id")
    a = docs.where(i % 7 != 0).select(i.alias("name"), F.col("source").alias("description"), F.col("lang").alias("input_schema"))
    b = docs.where(i % 3 != 0).select(i.alias("name"), F.when(i % 5 == 0, "x").otherwise(F.col("source")).alias("description"), F.when(i % 11 == 0, "y").otherwise(F.col("lang")).alias("input_schema"))
    return approvals.catalogue_diff(a, b)


# graph


def _edges(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"), F.when(F.col("o_orderkey") % 3 == 0, "defines").otherwise("calls").alias("kind"))


@query("SELECT 'n' || c_nationkey AS symbol, count(DISTINCT o_orderkey) AS n, min('o' || o_orderkey) AS first_other FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def symbol_callers(spark, d):
    return graph.callers(_edges(spark, d))


@query("SELECT n_name AS symbol, n_name AS display_name FROM nation WHERE contains(lower(n_name), 'ion_1') ORDER BY symbol LIMIT 20")
def symbol_find(spark, d):
    return graph.find_symbols(table(spark, d, "nation").select(F.col("n_name").alias("symbol"), F.col("n_name").alias("display_name")), "ION_1")


# monitoring


def _debt_rows(spark, d):
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("h"), (F.col("user_id") % 40).cast("string")).alias("claim_hash"), F.when(F.col("event_id") % 3 == 0, "waived").when(F.col("event_id") % 3 == 1, "paid").otherwise("pending").alias("status"),
                    F.col("ts").alias("created_at"), (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 100)).alias("decided_at"), (F.col("event_id") % 7 == 0).alias("lapsed"))


@query("""WITH b AS (SELECT count(*) AS blocks FROM events WHERE event_type = 'refund' AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS), t AS (SELECT count(*) AS turns FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAYS)
    SELECT blocks, turns, CASE WHEN blocks = 0 THEN 'dead' WHEN blocks * 100 > 30 * turns THEN 'inflated' END AS alert FROM b, t""")
def monitor_debt_blocks(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "refund", "commit:blocked").otherwise("commit:passed").alias("action"), F.col("ts").alias("created_at"))
    return monitoring.debt_blocks(e, e, _now())


@query("SELECT round(avg((event_id % 3 = 0)::INT), 6) AS waiver_rate, round(median(event_id % 100), 6) AS median_seconds, round(avg((event_id % 7 = 0)::INT), 6) AS lapse_rate, avg((event_id % 3 = 0)::INT) > 0.6 OR median(event_id % 100) < 30 OR avg((event_id % 7 = 0)::INT) > 0.2 AS alert FROM events WHERE event_id % 3 < 2")
def monitor_waivers(spark, d):
    return monitoring.waivers(_debt_rows(spark, d)).withColumns({c: F.round(c, 6) for c in ("waiver_rate", "median_seconds", "lapse_rate")})


@query("SELECT event_id AS belief_id FROM events WHERE ts + INTERVAL 5 DAYS <= TIMESTAMP '2024-01-20' AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 10 <> 0)")
def monitor_overdue(spark, d):
    e = table(spark, d, "events")
    beliefs = e.select(F.col("event_id").alias("belief_id"), F.lit("active").alias("status"), (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"))
    return monitoring.overdue(beliefs, e.where("event_id % 10 <> 0").select(F.col("event_id").alias("belief_id"), F.lit("open").alias("status")), _now())


@query("SELECT CAST(coalesce(sum((event_id % 1000 = 1)::INT), 0) AS BIGINT) AS breaches, CAST(sum((event_id % 1000 BETWEEN 2 AND 99)::INT) AS BIGINT) AS blocked FROM events")
def monitor_hold_breaches(spark, d):
    k = F.col("event_id") % 1000
    return monitoring.hold_breaches(table(spark, d, "events").select(F.when(k == 1, "hold:breach").when(k.between(2, 99), "hold:blocked").otherwise("other").alias("action")))


@query("""WITH s AS (SELECT user_id AS skill_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
    c AS (SELECT skill_id, CAST(sum((before IS NOT NULL AND before <> event_type)::INT) AS BIGINT) AS changes FROM s GROUP BY 1), g AS (SELECT user_id AS skill_id, count(*) AS events FROM events WHERE event_id % 2 = 0 GROUP BY 1)
    SELECT skill_id, coalesce(changes, 0) AS changes, coalesce(events, 0) AS events FROM c FULL OUTER JOIN g USING (skill_id) WHERE coalesce(changes, 0) <> coalesce(events, 0)""")
def monitor_silent_mutations(spark, d):
    e = table(spark, d, "events")
    snaps = e.select(F.col("user_id").alias("skill_id"), F.col("event_type").alias("hash"), F.struct("ts", "event_id").alias("created_at"))
    return monitoring.silent_mutations(snaps, e.where("event_id % 2 = 0").select(F.col("user_id").alias("skill_id"), F.lit("mutation").alias("action")))


@query("SELECT event_id AS belief_id FROM events WHERE event_type = 'click' AND event_id % 50 = 0")
def monitor_fast_beliefs(spark, d):
    e = table(spark, d, "events")
    return monitoring.fast_beliefs(e.select(F.col("event_id").alias("belief_id"), F.when(F.col("event_type") == "click", "belief").otherwise("unknown").alias("epistemic_type"), F.when(F.col("event_id") % 50 == 0, "fast").otherwise("gate").alias("committed_path")))


@query("SELECT 'h' || (user_id % 40) AS claim_hash, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 30 DAYS GROUP BY 1 HAVING count(*) >= 3")
def monitor_repeated_debts(spark, d):
    return monitoring.repeated_debts(_debt_rows(spark, d), _now())


@query()
def session_search(spark, d):
    """Every turn of every 50th conversation, searched in all turns."""
    c = table(spark, d, "conversations").withColumn("message_id", F.col("conv_id") * 1000 + F.col("turn"))
    asked = c.where("conv_id % 50 = 0").select(F.col("message_id").alias("query_id"), "text")
    return sessions.session_search(c.select("message_id", "text"), asked).select("query_id", "message_id", F.round("bm25", 6).alias("bm25"), "rank", "snippet")


@query(f"WITH {_LEAVES} SELECT chain, idx, {_UNTOUCHED.format(alone='n % 2 = 1 AND idx = n - 1')} AS ok FROM leaves JOIN sizes USING (chain)")
def mountain_proof_verify(spark, d):
    leaves = _leaves(spark, d)
    proofs = _tampered(chains.prove_all_in_mountains(leaves))
    ok = chains.verify_in_mountains(F.col("hash"), F.col("siblings"), F.col("was_right"), F.col("peak"), F.col("peaks"), F.col("root"))
    return proofs.select("chain", "idx", ok.alias("ok"))


# passages


@query("SELECT doc_id, true AS bounded, true AS whole, true AS numbered FROM documents")
def passage_bounds(spark, d):
    """Every passage is within the limit, all visible characters of the text are in its passages, and they are numbered from 0."""
    docs = table(spark, d, "documents")
    cut = split_passages(docs, ["doc_id"], "text")
    dense = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    got = cut.groupBy("doc_id").agg(F.max("est_tokens").alias("most"), F.sum(dense(F.col("body"))).alias("chars"), F.max("ordinal").alias("last"), F.count(F.lit(1)).alias("n"))
    met = docs.join(got, "doc_id", "left")
    return met.select("doc_id", (F.coalesce("most", F.lit(0)) <= 220).alias("bounded"), (F.coalesce("chars", F.lit(0)) == dense(F.col("text"))).alias("whole"), (F.coalesce(F.col("last") + 1, F.lit(0)) == F.coalesce("n", F.lit(0))).alias("numbered"))


@query()
def passages(spark, d):
    return split_passages(table(spark, d, "documents"), ["doc_id"], "text").select("doc_id", "ordinal", "body", "est_tokens")


from . import queries_ledger, queries_more  # noqa: E402, F401  (they register their own)
