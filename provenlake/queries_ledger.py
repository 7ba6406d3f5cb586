"""Registered queries of ranges that grow, receipts kept from earlier, gates and state machines, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from .materialise import durable
from .operators import mountains
from .plans.derive import table
from .queries import query

_FIRST_PART = 60


def _entries(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"))


_ALL_LEAVES = "{out} AS (SELECT user_id AS chain, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sha256(event_id::VARCHAR) AS hash FROM events)"


def _fold_sql(leaves: str, out: str) -> str:
    """The binary counter leaf by leaf: chain, n, peaks, for every prefix."""
    return f"""{out} AS (SELECT chain, n, list_value({{'h': 0, 'x': hash}}) AS peaks FROM {leaves} WHERE n = 1
        UNION ALL SELECT f.chain, l.n, list_reduce(list_prepend(list_value({{'h': 0, 'x': l.hash}}), list_transform(f.peaks, lambda p: list_value(p))),
            lambda acc, p: CASE WHEN acc[1].h = p[1].h AND len(acc) = 1 THEN list_value({{'h': p[1].h + 1, 'x': sha256(p[1].x || acc[1].x)}}) ELSE list_concat(acc, p) END) FROM {out} f JOIN {leaves} l ON l.chain = f.chain AND l.n = f.n + 1)"""


_ROOT = "list_reduce(list_transform(peaks, lambda p: p.x), lambda a, b: sha256(a || b))"


def _two_appends(spark, d):
    """Nodes of the first appends, nodes of the second ones, and the peaks after them."""
    entries = _entries(spark, d)
    cut = entries.agg(F.expr(f"max(seq) * {_FIRST_PART} div 100").alias("cut"))  # one row
    first = entries.crossJoin(F.broadcast(cut)).where("seq <= cut").drop("cut")
    none = spark.createDataFrame([], "chain long, height int, place long, hash string")
    nodes, peaks = mountains.sync(none, first)
    more, peaks = mountains.sync(peaks, entries, first.groupBy("chain").agg(F.max("seq").alias("seq")))
    return nodes, more, peaks


@query(f"""WITH RECURSIVE {_ALL_LEAVES.format(out="leaves")}, {_fold_sql("leaves", "fold")}, last AS (SELECT chain, max(n) AS n FROM leaves GROUP BY chain)
    SELECT chain, n AS leaf_count, {_ROOT} AS root, CAST(len(peaks) AS BIGINT) AS n_peaks FROM fold JOIN last USING (chain, n)""")
def mountain_sync(spark, d):
    """Two appends give the peaks and the root of one range."""
    _, _, peaks = _two_appends(spark, d)
    sizes = peaks.groupBy("chain").agg(F.sum(F.expr("shiftleft(1L, height)")).alias("leaf_count"), F.count(F.lit(1)).alias("n_peaks"))
    return mountains.prefix_roots(peaks, sizes).select("chain", "leaf_count", "root", "n_peaks")


@query(f"""WITH RECURSIVE {_ALL_LEAVES.format(out="leaves")}, {_fold_sql("leaves", "fold")}, roots AS (SELECT chain, n AS leaf_count, {_ROOT} AS root FROM fold WHERE n % 16 = 0)
    SELECT *, sha256(coalesce(lag(root) OVER (PARTITION BY chain ORDER BY leaf_count), 'GENESIS') || chr(10) || root) AS link FROM roots""")
def mountain_checkpoints(spark, d):
    """A checkpoint whenever 16 leaves have come, over two appends; the second one's link to what is stored."""
    nodes, more, _ = _two_appends(spark, d)
    stored = durable(mountains.auto_checkpoints(nodes, 16))  # it is asked for twice
    newest = stored.groupBy("chain").agg(F.max("leaf_count").alias("leaf_count"), F.max_by("root", "leaf_count").alias("root"))
    return stored.unionByName(mountains.auto_checkpoints(nodes.unionByName(more), 16, newest))


# Histories that were changed after their receipts were taken: a third of the chains lose entries and grow afterwards, a third have their first entry
# rewritten, the others only grow. Receipts attest the first half; anchors the first quarter, half, and three quarters.

_CHANGED = f"""{_ALL_LEAVES.format(out="orig")}, {_fold_sql("orig", "was")},
    sizes AS (SELECT chain, count(*) AS size FROM orig GROUP BY chain),
    kept AS (SELECT chain, seq, CASE WHEN chain % 3 = 1 AND n = 1 THEN sha256('x' || seq) ELSE hash END AS hash FROM orig JOIN sizes USING (chain) WHERE NOT (chain % 3 = 2 AND n > size // 4 AND n <= size // 2)),
    curr AS (SELECT chain, seq, row_number() OVER (PARTITION BY chain ORDER BY seq) AS n, hash FROM kept), {_fold_sql("curr", "now")},
    receipts AS (SELECT o.chain, q AS no, o.seq AS last_seq, o.n AS leaf_count, {_ROOT.replace("peaks", "w.peaks")} AS root FROM (SELECT *, unnest([1, 2, 3]) AS q FROM sizes) s JOIN orig o ON o.chain = s.chain AND o.n = size * q // 4 JOIN was w ON w.chain = o.chain AND w.n = o.n),
    left_of AS (SELECT r.chain, r.no, count(c.seq) AS m FROM receipts r LEFT JOIN curr c ON c.chain = r.chain AND c.seq <= r.last_seq GROUP BY ALL),
    judged AS (SELECT r.*, CASE WHEN m = 0 THEN 'none_left' WHEN m < leaf_count THEN 'fewer' WHEN {_ROOT.replace("peaks", "n.peaks")} IS DISTINCT FROM root THEN 'rewritten' ELSE 'ok' END AS verdict
               FROM receipts r JOIN left_of USING (chain, no) LEFT JOIN now n ON n.chain = r.chain AND n.n = m)"""


def _changed_history(spark, d):
    """receipts, entries as they are now, and their nodes."""
    from .operators.ordered import numbered

    none = spark.createDataFrame([], "chain long, height int, place long, hash string")
    orig = durable(numbered(_entries(spark, d), ["chain"], "seq"))
    sizes = orig.groupBy("chain").agg(F.count(F.lit(1)).alias("size"))
    was = mountains.append_leaves(none, orig)
    asked = sizes.withColumn("no", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("chain", "no", F.expr("size * no div 4").alias("leaf_count"))
    receipts = mountains.prefix_roots(was, asked.where("leaf_count > 0")).join(orig.select("chain", (F.col("idx") + 1).alias("leaf_count"), F.col("seq").alias("last_seq")), ["chain", "leaf_count"])
    met = orig.join(sizes, "chain").where("NOT (chain % 3 = 2 AND idx >= size div 4 AND idx < size div 2)")
    entries = durable(met.select("chain", "seq", F.when((F.col("chain") % 3 == 1) & (F.col("idx") == 0), F.sha2(F.concat(F.lit("x"), F.col("seq").cast("string")), 256)).otherwise(F.col("hash")).alias("hash")))
    return receipts, entries, mountains.append_leaves(none, entries)


@query(f"WITH RECURSIVE {_CHANGED} SELECT chain, leaf_count, verdict FROM judged WHERE no = 2")
def prefix_verify(spark, d):
    receipts, entries, nodes = _changed_history(spark, d)
    return mountains.verify_prefixes(receipts.where("no = 2"), entries, nodes).select("chain", "leaf_count", "verdict")


@query(f"""WITH RECURSIVE {_CHANGED}, tips AS (SELECT chain, max(seq) AS seq2, count(*) AS n2 FROM curr GROUP BY chain),
    told AS (SELECT j.chain, no, CASE WHEN j.chain % 31 = 7 THEN 'audit' WHEN seq2 < last_seq THEN 'seq_backwards' WHEN n2 < leaf_count THEN 'leaves_fell'
                WHEN seq2 = last_seq AND (SELECT {_ROOT.replace("peaks", "n.peaks")} FROM now n WHERE n.chain = j.chain AND n.n = n2) IS DISTINCT FROM root THEN 'same_length_other_root' WHEN verdict <> 'ok' THEN verdict END AS reason FROM judged j JOIN tips USING (chain))
    SELECT chain, count(reason) = 0 AS ok, count(*) AS anchors, min(no) FILTER (reason IS NOT NULL) AS failed_at, min_by(reason, no) FILTER (reason IS NOT NULL) AS reason FROM told GROUP BY chain""")
def verify_against_anchors(spark, d):
    """Every anchor counts, the older ones too; one chain in 31 fails its own verification."""
    receipts, entries, nodes = _changed_history(spark, d)
    tips = entries.groupBy("chain").agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("leaf_count"))
    current = mountains.prefix_roots(nodes, tips).withColumn("audit_ok", F.col("chain") % 31 != 7)
    return mountains.verify_against(receipts, current, entries, nodes)


# The whole gate over the conversations: 61 claims in four types, some of which restate each other (by the embeddings of their numbers), with
# revisions, citations of beliefs and of documents, payments and waivers.

_THRESHOLD = 0.25
_GATE_ROWS = """n_rows AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations),
    raw AS (SELECT n AS seq, (n * 7919) % 61 AS k, CASE WHEN n % 7 = 2 THEN 'pay' WHEN n % 23 = 9 THEN 'waive' ELSE 'commit' END AS event,
        CASE WHEN n % 11 = 3 THEN 'defeater' WHEN n % 13 = 5 THEN 'observation' WHEN n % 17 = 4 THEN 'commitment' ELSE 'belief' END AS epistemic_type,
        CASE WHEN n % 19 = 6 THEN 'fast' ELSE 'slow' END AS path, CASE WHEN n % 5 = 1 THEN n - n % 29 - 1 END AS revision_of, n % 5 = 0 AS strict FROM n_rows),
    events_in AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'not ' ELSE '' END || 'a claim about ' || chr((97 + k % 26)::INTEGER) || chr((97 + k // 26)::INTEGER) AS text FROM raw),
    hashed AS (SELECT *, sha256(epistemic_type || chr(10) || text) AS claim_hash FROM events_in),
    srcs AS (SELECT seq, 0 AS no, 'vault_page' AS kind, NULL AS ref, true AS pinned, seq % 4 <> 1 AS verified, CASE WHEN seq % 4 = 1 THEN 'hash_mismatch' END AS reason FROM raw WHERE seq % 3 <> 0 AND event = 'commit'
        UNION ALL SELECT seq, 1, 'belief', seq - 1 - seq % 15, true, NULL, NULL FROM raw WHERE seq % 8 = 5 AND event = 'commit'
        UNION ALL SELECT seq, 2, 'vault_page', NULL, false, false, NULL FROM raw WHERE seq % 41 = 7 AND event = 'commit')"""


@query(f"""WITH RECURSIVE {_GATE_ROWS},
    claims AS (SELECT DISTINCT claim_hash, text, k FROM hashed),
    restated AS (SELECT a.claim_hash AS a, list(b.claim_hash) AS others FROM claims a JOIN claims b ON a.claim_hash <> b.claim_hash AND (a.k % 9 = 0) = (b.k % 9 = 0)
        JOIN embeddings x ON x.vec_id = a.k JOIN embeddings y ON y.vec_id = b.k WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= {_THRESHOLD} GROUP BY 1),
    up AS (SELECT seq, revision_of AS anc FROM raw WHERE revision_of IS NOT NULL AND event = 'commit' UNION SELECT up.seq, r.revision_of FROM up JOIN raw r ON r.seq = up.anc WHERE r.revision_of IS NOT NULL AND r.event = 'commit'),
    above AS (SELECT up.seq, list(h.claim_hash) AS hashes FROM up JOIN hashed h ON h.seq = up.anc GROUP BY 1),
    cites AS (SELECT s.seq, list(s.ref) AS refs, list(s.ref) FILTER (h.epistemic_type = 'defeater') AS defeaters FROM srcs s LEFT JOIN hashed h ON h.seq = s.ref WHERE s.kind = 'belief' GROUP BY 1),
    counts AS (SELECT seq, count(*) AS n_sources, bool_or(NOT pinned) AS no_pin, count(*) FILTER (kind <> 'belief' AND verified) AS n_corpus, coalesce(list(reason) FILTER (reason IS NOT NULL), []) AS reasons FROM srcs GROUP BY 1),
    e AS (SELECT h.*, coalesce(others, []) AS others, coalesce(hashes, []) AS hashes, coalesce(refs, []) AS refs, coalesce(defeaters, []) AS defeaters, coalesce(n_sources, 0) AS n_sources, coalesce(no_pin, false) AS no_pin, coalesce(n_corpus, 0) AS n_corpus, coalesce(reasons, []) AS reasons,
            h.epistemic_type IN ('belief', 'commitment') AS asserts
          FROM hashed h LEFT JOIN restated s ON s.a = h.claim_hash LEFT JOIN above USING (seq) LEFT JOIN cites USING (seq) LEFT JOIN counts USING (seq)),
    f AS (SELECT 0::BIGINT AS seq, []::BIGINT[] AS taken, []::STRUCT(id BIGINT, h VARCHAR)[] AS owed, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reason, []::BIGINT[] AS debts, 0::BIGINT AS n_verified, []::VARCHAR[] AS rejected, NULL::VARCHAR AS paraphrase
        UNION ALL
        SELECT seq, CASE WHEN event = 'commit' AND reason IS NULL THEN list_append(taken, seq) ELSE taken END,
            CASE WHEN event <> 'commit' THEN list_filter(owed, lambda o: o.h <> claim_hash) WHEN reason IS NULL AND asserts AND n_verified = 0 THEN list_append(owed, {{'id': seq, 'h': claim_hash}}) ELSE owed END,
            CASE WHEN event <> 'commit' THEN event WHEN reason IS NOT NULL THEN 'rejected' WHEN asserts AND n_verified = 0 THEN 'committed_with_debt' ELSE 'committed' END, reason,
            CASE WHEN event <> 'commit' THEN list_sort(list_transform(list_filter(owed, lambda o: o.h = claim_hash), lambda o: o.id)) WHEN reason = 'open_debt' THEN met ELSE [] END, n_verified, rejected,
            CASE WHEN event <> 'commit' THEN NULL WHEN NOT asserts THEN 'not_applicable' WHEN reason IS NOT NULL AND reason NOT IN ('open_debt', 'strict_without_sources', 'strict_none_verified') THEN 'not_reached'
                 WHEN len(list_filter(owed, lambda o: o.h <> claim_hash)) = 0 THEN 'no_candidates' ELSE 'ran' END
        FROM (SELECT *, CASE WHEN event <> 'commit' OR early IN ('fast_path', 'source_missing_pin') THEN 0 ELSE n_corpus + n_known END AS n_verified,
                CASE WHEN event <> 'commit' OR early IN ('fast_path', 'source_missing_pin') THEN [] ELSE list_concat(list_sort(reasons), list_transform(range(len(refs) - n_known), lambda x: 'belief_not_found')) END AS rejected,
                CASE WHEN event <> 'commit' THEN NULL WHEN early IS NOT NULL THEN early WHEN NOT asserts THEN NULL WHEN len(met) > 0 THEN 'open_debt'
                     WHEN strict AND n_corpus + n_known = 0 THEN CASE WHEN n_sources = 0 THEN 'strict_without_sources' ELSE 'strict_none_verified' END END AS reason
              FROM (SELECT e.*, f.taken, f.owed, len(list_filter(refs, lambda r: list_contains(taken, r))) AS n_known,
                      list_sort(list_transform(list_filter(owed, lambda o: o.h = claim_hash OR list_contains(hashes, o.h) OR list_contains(others, o.h)), lambda o: o.id)) AS met,
                      CASE WHEN path = 'fast' AND asserts THEN 'fast_path' WHEN no_pin THEN 'source_missing_pin' WHEN revision_of IS NOT NULL AND NOT list_contains(taken, revision_of) THEN 'parent_not_found'
                           WHEN len(list_filter(defeaters, lambda r: list_contains(taken, r))) > 0 THEN 'defeater_cannot_source' END AS early
                    FROM f JOIN e ON e.seq = f.seq + 1)))
    SELECT seq, outcome, reason, array_to_string(debts, ',') AS debt_ids, n_verified::INTEGER AS n_verified, array_to_string(rejected, ',') AS rejected, paraphrase FROM f WHERE seq > 0""")
def full_commit_gate(spark, d):
    from .functions.claims import claims_differ
    from .functions.hashing import pin_hash
    from .functions.vectors import cosine
    from .operators import gate, pins
    from .operators.ordered import numbered

    c = table(spark, d, "conversations").select(F.lit(0).alias("all"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    n = F.col("idx") + 1
    rows = numbered(c, ["all"], "at").select(n.alias("seq"), (n * 7919 % 61).alias("k")).withColumns({
        "event": F.when(F.col("seq") % 7 == 2, "pay").when(F.col("seq") % 23 == 9, "waive").otherwise("commit"),
        "epistemic_type": F.when(F.col("seq") % 11 == 3, "defeater").when(F.col("seq") % 13 == 5, "observation").when(F.col("seq") % 17 == 4, "commitment").otherwise("belief"),
        "path": F.when(F.col("seq") % 19 == 6, "fast").otherwise("slow"), "revision_of": F.when(F.col("seq") % 5 == 1, F.col("seq") - F.col("seq") % 29 - 1), "strict": F.col("seq") % 5 == 0,
        "text": F.concat(F.when(F.col("k") % 9 == 0, "not ").otherwise(""), F.lit("a claim about "), F.char(97 + F.col("k") % 26), F.char(97 + F.expr("k div 26"))),
    })
    events = rows.withColumn("claim_hash", F.sha2(F.concat("epistemic_type", F.lit("\n"), "text"), 256))
    commits = events.where("event = 'commit'")
    # Pins on documents; a quarter of them holds another text's hash.
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("vault_page").alias("kind"), F.col("source").alias("title"), F.col("text").alias("body"), F.col("lang").alias("ref"), F.lit("root").alias("ingest_root"))
    some = docs.select("id", pin_hash(F.col("title"), F.col("body"), F.col("ref")).alias("good"))
    cited = commits.where("seq % 3 <> 0").select("seq", (F.col("seq") * 31 % 200).cast("string").alias("id")).join(some, "id")
    pinned = cited.select(F.col("seq").alias("pin_id"), F.col("seq").alias("belief_id"), F.lit("vault_page").alias("kind"), F.col("id").alias("ref_id"), F.when(F.col("seq") % 4 == 1, F.reverse("good")).otherwise(F.col("good")).alias("snapshot_hash"))
    verdicts = pins.verify_pins(pinned, docs, rescue=False)
    no = lambda t: F.lit(None).cast(t)
    corpus = verdicts.select(F.col("pin_id").alias("seq"), F.lit(0).alias("no"), F.lit("vault_page").alias("kind"), no("long").alias("ref"), F.lit(True).alias("pinned"), "verified", "reason")
    beliefs = commits.where("seq % 8 = 5").select("seq", F.lit(1).alias("no"), F.lit("belief").alias("kind"), (F.col("seq") - 1 - F.col("seq") % 15).alias("ref"), F.lit(True).alias("pinned"), no("boolean").alias("verified"), no("string").alias("reason"))
    bare = commits.where("seq % 41 = 7").select("seq", F.lit(2).alias("no"), F.lit("vault_page").alias("kind"), no("long").alias("ref"), F.lit(False).alias("pinned"), F.lit(False).alias("verified"), no("string").alias("reason"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    claims = events.select("claim_hash", "text", "k").distinct().join(vectors, "k")
    side = lambda x: claims.select(F.col("claim_hash").alias(x), F.col("text").alias(f"t_{x}"), F.col("embedding").alias(f"v_{x}"))
    # 61 texts in four types at most: a stated number of claims against themselves.
    alike = side("a").join(side("b"), F.col("a") != F.col("b")).where((cosine(F.col("v_a"), F.col("v_b")) >= _THRESHOLD) & claims_differ(F.col("t_a"), F.col("t_b")).isNull())
    out = gate.full_commit_gate(events, corpus.unionByName(beliefs).unionByName(bare), alike.select("a", "b"))
    return out.select("seq", "outcome", "reason", F.array_join("debt_ids", ",").alias("debt_ids"), "n_verified", F.array_join("rejected", ",").alias("rejected"), "paraphrase")


# Pending writes: every event is a proposal, a decision or an application of one of the writes of its user.

_LIFE = """ev AS (SELECT user_id * 20 + event_id % 20 AS write_id, event_id AS seq, ts AS moment, CASE (event_id * 7919 // 13) % 10 WHEN 0 THEN 'apply' WHEN 1 THEN 'reject' WHEN 2 THEN 'approve' WHEN 3 THEN 'approve' WHEN 4 THEN 'apply' WHEN 5 THEN 'apply' ELSE 'propose' END AS kind,
        CASE event_id % 5 WHEN 0 THEN 'skill' WHEN 1 THEN 'memory' WHEN 2 THEN 'belief' WHEN 3 THEN 'constitution' ELSE 'user_profile' END AS target, CASE event_id % 4 WHEN 0 THEN 'dream' ELSE 'foreground' END AS origin, CASE WHEN event_id % 2 = 0 THEN 24 + event_id % 3 * 48 END AS ttl_hours FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY write_id ORDER BY moment, seq) AS n FROM ev)"""
_LIFE_NOW = "2024-01-25"


@query(f"""WITH RECURSIVE {_LIFE},
    f AS (SELECT DISTINCT write_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS code, NULL::VARCHAR AS status, NULL::TIMESTAMP AS expires FROM ev
        UNION ALL
        SELECT write_id, n, seq, kind, code, CASE WHEN code IN ('queued') THEN 'pending' WHEN code = 'applied_immediate' THEN 'approved' WHEN code = 'rejected_by_policy' THEN 'refused' WHEN code = 'ok' THEN CASE kind WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' ELSE 'applied' END ELSE st END,
            CASE WHEN code IN ('queued', 'applied_immediate') THEN moment + to_hours(coalesce(ttl_hours, 72)::INTEGER) ELSE expires END
        FROM (SELECT *, CASE WHEN kind = 'propose' THEN CASE WHEN st IS NOT NULL THEN 'duplicate' WHEN target = 'skill' AND origin = 'dream' THEN 'rejected_by_policy' WHEN target IN ('memory', 'user_profile') THEN 'applied_immediate' ELSE 'queued' END
                WHEN st IS NULL OR st = 'refused' THEN 'not_found'
                WHEN kind = 'apply' THEN CASE st WHEN 'approved' THEN 'ok' WHEN 'applied' THEN 'idempotent' WHEN 'rejected' THEN 'already_rejected' WHEN 'expired' THEN 'expired' ELSE 'cannot_apply' END
                WHEN st = 'pending' THEN 'ok' WHEN st = 'expired' THEN 'expired'
                WHEN (kind = 'approve') = (st IN ('approved', 'applied')) THEN 'idempotent' WHEN st = 'applied' THEN 'already_applied' ELSE 'conflict_opposite' END AS code
              FROM (SELECT o.*, f.expires, CASE WHEN f.status = 'pending' AND o.moment > f.expires THEN 'expired' ELSE f.status END AS st FROM f JOIN o ON o.write_id = f.write_id AND o.n = f.n + 1))),
    swept AS (SELECT write_id, max_by(status, n) AS status, bool_or(code = 'queued') AS waited, max(expires) AS expires, bool_or(code = 'ok' AND kind IN ('approve', 'reject')) AS decided FROM f GROUP BY write_id)
    SELECT write_id, seq, kind, code, nullif(status, 'refused') AS status FROM f WHERE n > 0
    UNION ALL SELECT write_id, NULL, 'expire', 'expired', 'expired' FROM swept WHERE waited AND NOT coalesce(decided, false) AND expires < TIMESTAMP '{_LIFE_NOW}'""")
def write_lifecycle(spark, d):
    from .operators import writes

    return writes.write_lifecycle(life_events(spark, d), writes.Policy(memory=False, auto_skill_improve="off"), F.lit(f"{_LIFE_NOW} 00:00:00").cast("timestamp"))


def life_events(spark, d):
    i = F.col("event_id")
    pick = F.expr("event_id * 7919 div 13 % 10")
    kind = F.when(pick.isin(0, 4, 5), "apply").when(pick == 1, "reject").when(pick.isin(2, 3), "approve").otherwise("propose")
    target = F.element_at(F.array(*map(F.lit, ("skill", "memory", "belief", "constitution", "user_profile"))), (i % 5 + 1).cast("int"))
    return table(spark, d, "events").select((F.col("user_id") * 20 + i % 20).alias("write_id"), i.alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"), target.alias("target"), F.when(i % 4 == 0, "dream").otherwise("foreground").alias("origin"), F.when(i % 2 == 0, 24 + i % 3 * 48).alias("ttl_hours"))


@query("""WITH holds AS (SELECT event_id AS hold_id, CASE event_id % 3 WHEN 0 THEN 'belief_stale' ELSE 'mutation_pending' END AS kind, event_id % 11 = 0 AS released FROM events WHERE event_type = 'purchase'),
    rel AS (SELECT event_id AS release_id, event_id - event_id % 8 + event_id % 3 AS hold_id, CASE event_id % 2 WHEN 0 THEN 'belief_stale' ELSE 'mutation_pending' END AS expected_kind FROM events WHERE event_type <> 'purchase')
    SELECT release_id, hold_id, CASE WHEN h.kind IS NULL THEN 'not_found' WHEN h.released OR EXISTS (SELECT 1 FROM rel e WHERE e.hold_id = r.hold_id AND e.release_id < r.release_id AND e.expected_kind = h.kind) THEN 'already_released' WHEN h.kind <> expected_kind THEN 'kind_mismatch' ELSE 'released' END AS code
    FROM rel r LEFT JOIN holds h USING (hold_id)""")
def hold_releases(spark, d):
    from .operators import writes

    e, i = table(spark, d, "events"), F.col("event_id")
    holds = e.where("event_type = 'purchase'").select(i.alias("hold_id"), F.when(i % 3 == 0, "belief_stale").otherwise("mutation_pending").alias("kind"), (i % 11 == 0).alias("released"))
    asked = e.where("event_type <> 'purchase'").select(i.alias("release_id"), (i - i % 8 + i % 3).alias("hold_id"), F.when(i % 2 == 0, "belief_stale").otherwise("mutation_pending").alias("expected_kind"))
    return writes.release_holds(holds, asked)


@query("""WITH r AS (SELECT event_id AS request_id, user_id AS skill_id, ts AS moment, 'h' || event_id % 3 AS content_hash, CASE WHEN event_id % 4 = 0 THEN ['read', 'net'] ELSE ['read'] END AS requested, event_id % 97 = 0 AS has_secret, CASE WHEN event_id % 15 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'passed' ELSE 'parked' END END AS faculty FROM events WHERE event_id % 5 = 0),
    s AS (SELECT user_id AS skill_id, ts AS created_at, 'h' || event_id % 3 AS cleared_hash, CASE WHEN event_id % 3 <> 0 THEN ['read'] END AS manifest FROM events WHERE event_id % 7 = 1 AND event_id % 2 = 0 AND event_id % 13 <> 0),
    h AS (SELECT user_id AS skill_id, ts AS opened_at, CASE WHEN event_id % 3 <> 0 THEN ts + INTERVAL 6 HOURS END AS released_at FROM events WHERE event_id % 211 = 2),
    dep AS (SELECT user_id AS skill_id, 'b' || event_id AS belief_id, ts AS stale_at FROM events WHERE event_id % 131 = 3 AND event_id % 2 = 0 AND event_id % 5 <> 0),
    m AS (SELECT r.*, (SELECT max_by({'h': cleared_hash, 'm': manifest}, created_at) FROM s WHERE s.skill_id = r.skill_id AND created_at <= moment) AS snap,
            (SELECT count(*) FROM h WHERE h.skill_id = r.skill_id AND opened_at <= moment AND (released_at IS NULL OR released_at > moment)) AS held, coalesce((SELECT list_sort(list(DISTINCT belief_id)) FROM dep WHERE dep.skill_id = r.skill_id AND stale_at <= moment), []) AS stale, moment >= TIMESTAMP '2024-01-15' AS teeth FROM r),
    c AS (SELECT *, CASE WHEN snap IS NULL THEN 'no_cleared_snapshot' WHEN snap.h <> content_hash THEN 'mutation_delta' END AS mutation, CASE WHEN snap.m IS NOT NULL THEN list_filter(requested, lambda x: NOT list_contains(snap.m, x)) ELSE [] END AS over FROM m),
    w AS (SELECT *, CASE WHEN held > 0 THEN 'open_holds' WHEN has_secret THEN 'secret' WHEN teeth AND len(stale) > 0 THEN 'stale:' || stale[1] WHEN teeth AND mutation IS NOT NULL THEN mutation WHEN len(over) > 0 THEN 'capabilities:' || array_to_string(over, ',') WHEN faculty <> 'passed' THEN 'faculty:' || faculty END AS reason FROM c),
    n AS (SELECT *, CASE WHEN reason IS NULL AND NOT teeth THEN list_concat(list_transform(stale, lambda b: 'stale:' || b), CASE WHEN mutation IS NULL THEN [] ELSE [mutation] END) ELSE [] END AS noted FROM w)
    SELECT request_id, reason IS NULL AS ok, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN len(noted) > 0 THEN 'shadow_activated' ELSE 'activated' END AS outcome, reason, array_to_string(noted, ',') AS would_refuse FROM n""")
def skill_activations(spark, d):
    """Requests against holds, dependencies and snapshots as tables, each as of its time; refusals have teeth from a flip time on."""
    from .operators import writes

    e, i = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.col("event_id")
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    words = lambda *w: F.array(*map(F.lit, w))
    requests = e.where("event_id % 5 = 0").select(i.alias("request_id"), F.col("user_id").alias("skill_id"), F.col("ts").alias("at"), text("h", i % 3).alias("content_hash"), F.when(i % 4 == 0, words("read", "net")).otherwise(words("read")).alias("requested"), (i % 97 == 0).alias("has_secret"))
    faculty = e.where("event_id % 15 = 0").select(i.alias("request_id"), F.when(i % 2 == 0, "passed").otherwise("parked").alias("status"))
    snapshots = e.where("event_id % 7 = 1").select(F.col("user_id").alias("skill_id"), F.col("ts").alias("created_at"), F.when(i % 2 == 0, "passed").otherwise("failed").alias("clearance"), F.when(i % 13 != 0, text("h", i % 3)).alias("cleared_hash"), F.when(i % 3 != 0, words("read")).alias("manifest"))
    holds = e.where("event_id % 211 = 2").select(F.col("user_id").alias("skill_id"), F.col("ts").alias("opened_at"), F.when(i % 3 != 0, F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias("released_at"))
    deps = e.where("event_id % 131 = 3").select(F.col("user_id").alias("skill_id"), text("b", i).alias("belief_id"), (i % 2 == 0).alias("load_bearing"), F.when(i % 5 != 0, F.col("ts")).alias("stale_at"))
    out = writes.activations(requests, holds, deps, snapshots, F.lit("2024-01-15 00:00:00").cast("timestamp"), faculty=faculty)
    return out.withColumn("would_refuse", F.array_join("would_refuse", ","))
