"""Hash chains, Merkle trees and mountain ranges over many chains at once.

Appending goes along a chain in one task and is parallel across chains. An entry is verified by hashing it again and comparing
it with its neighbour, in buckets of the order, so that one long chain is many tasks. Trees are built level by level with one group-by a
level, so no task holds a whole tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.hashing import chain_hash, checkpoint_link, merkle_parent
from ..materialise import durable
from ..sources.sinks import anchor
from .ordered import numbered, with_previous

GENESIS = "GENESIS"
AUTO_CHECKPOINT = 64
#: Levels of a tree between two writes to the shared folder.
CUT_EVERY = 8
#: Nodes of a level that one row holds where paths and new nodes are found.
PART_BITS = 8
PART = 1 << PART_BITS
#: Fixed: the keys of an audit entry's JSON, in order; nulls are written.
ENTRY_KEYS = ("id", "category", "action", "actor", "actorDetail", "subjectKind", "subjectId", "turnId", "sessionId", "profileId", "detail", "createdAt")


def entry_payload(**columns: Column) -> Column:
    """The JSON of an audit entry; keys not given are null."""
    return F.to_json(F.struct(*[columns.get(k, F.lit(None).cast("string")).alias(k) for k in ENTRY_KEYS]), {"ignoreNullFields": "false"})


def append_chain(rows: DataFrame, chain: str, seq: str, payload: str, tips: DataFrame | None = None) -> DataFrame:
    """chain, seq, payload, prev_hash, entry_hash.

    tips: chain, tip — where chains go on. Entries reach the fold sorted by the shuffle and pass through
    it in batches; it keeps one hash a chain, so a long chain needs time but no memory.
    """
    df = rows.select(F.col(chain).alias("chain"), F.col(seq).cast("long").alias("seq"), F.col(payload).alias("payload"))
    df = df.withColumn("tip", F.lit(None).cast("string")) if tips is None else df.join(tips.select("chain", "tip"), "chain", "left")
    ordered = df.repartition("chain").sortWithinPartitions("chain", "seq")
    schema = ordered.select("chain", "seq", "payload", F.lit("").alias("prev_hash"), F.lit("").alias("entry_hash")).schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        at, prev = object(), GENESIS
        for pdf in batches:
            before, after = [], []
            for c, p, tip in zip(pdf["chain"], pdf["payload"], pdf["tip"], strict=True):
                if c != at:
                    at, prev = c, tip or GENESIS
                before.append(prev)
                prev = sha256(f"{prev}\n{p}".encode()).hexdigest()
                after.append(prev)
            yield pdf[["chain", "seq", "payload"]].assign(prev_hash=before, entry_hash=after)

    return ordered.mapInPandas(fold, schema)


def verify_chain(entries: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """chain, ok, checked, broken_at, reason: the first entry whose link or hash is wrong; then the stored tip."""
    linked = with_previous(numbered(entries, ["chain"], "seq", "n"), ["chain"], "seq", "entry_hash", "want", F.lit(GENESIS)).withColumn("n", F.col("n") + 1)
    why = F.when(F.col("prev_hash") != F.col("want"), "prev_hash").when(chain_hash(F.col("prev_hash"), F.col("payload")) != F.col("entry_hash"), "entry_hash")
    out = linked.withColumn("why", why).groupBy("chain").agg(
        F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("why").isNotNull(), F.struct("seq", "n", "why"))).alias("bad"), F.max_by("entry_hash", "seq").alias("last")
    )
    reason = F.col("bad.why")
    if tips is not None:
        out = out.join(tips.select("chain", "tip"), "chain", "left")
        reason = F.when(F.col("bad").isNotNull(), F.col("bad.why")).when(F.col("tip") != F.col("last"), "tip")
    return out.select("chain", reason.isNull().alias("ok"), F.coalesce(F.col("bad.n") - 1, F.col("total")).cast("long").alias("checked"), F.col("bad.seq").alias("broken_at"), reason.alias("reason"))


def assert_chain(entries: DataFrame, tips: DataFrame | None = None) -> None:
    broken = verify_chain(entries, tips).where("NOT ok").limit(1).collect()
    if broken:
        raise ValueError(f"chain {broken[0].chain} is broken at {broken[0].broken_at}: {broken[0].reason}")


def leaves_of(entries: DataFrame) -> DataFrame:
    """chain, idx (from 0), hash: the entry hashes of each chain in order."""
    return numbered(entries.select("chain", "seq", F.col("entry_hash").alias("hash")), ["chain"], "seq").select("chain", "idx", "hash")


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """Every level from the leaves (chain, idx, hash) to the roots; an odd node is paired with itself."""
    sizes = leaves.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    level, out = leaves.select("chain", "idx", "hash").join(sizes, "chain"), [leaves.select("chain", "idx", "hash")]
    while most > 1:
        pair = level.groupBy("chain", "n", F.floor(F.col("idx") / 2).alias("idx")).agg(F.min_by("hash", "idx").alias("l"), F.max_by("hash", "idx").alias("r"))
        # A chain that has come to its root already keeps it.
        level = pair.select("chain", "idx", F.when(F.col("n") == 1, F.col("l")).otherwise(merkle_parent(F.col("l"), F.col("r"))).alias("hash"), F.ceil(F.col("n") / 2).alias("n"))
        most = -(-most // 2)
        if len(out) % CUT_EVERY == 0 and most > 1:
            level = durable(level)
        out.append(level.select("chain", "idx", "hash"))
    return out


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """chain, leaf_count, root."""
    return merkle_levels(leaves)[-1].select("chain", F.col("hash").alias("root")).join(leaves.groupBy("chain").agg(F.count(F.lit(1)).alias("leaf_count")), "chain")


def _parts(level: DataFrame) -> DataFrame:
    """chain, part, h: the hashes of each aligned stretch of PART nodes of a level (chain, idx, hash), in order."""
    return level.groupBy("chain", F.expr(f"shiftright(idx, {PART_BITS})").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("h"))


def _levels_in(h: Column) -> Column:
    """The nodes of a stretch at heights 0 to PART_BITS; an odd node is paired with itself."""
    up = lambda nodes: F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda i: merkle_parent(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.get(nodes, 2 * i))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(PART_BITS)), F.array(h), lambda levels, _: F.concat(levels, F.array(up(F.element_at(levels, -1)))))


def _paths(parts: DataFrame, steps: str) -> DataFrame:
    """The rows of parts (h, levels, ...) once for each node, with its place ``j`` in the part, hash, siblings and was_right; steps: how far up, by j and m (nodes of the part)."""
    sibling = "coalesce(get(levels[k], cast(shiftright(j, k) ^ 1 as int)), levels[k][shiftright(j, k)])"
    heights = f"slice(sequence(0, {PART_BITS - 1}), 1, cast({steps} as int))"
    each = f"transform(h, (x, j) -> named_struct('j', j, 'hash', x, 'siblings', transform({heights}, k -> {sibling}), 'was_right', transform({heights}, k -> shiftright(j, k) % 2 = 1)))"
    others = [c for c in parts.columns if c not in ("h", "levels")]
    return parts.select(*others, F.expr(f"inline({each})"))


#: Steps to the root of a tree in one part; other parts, and a full first one, go to the part's own root.
_TO_ROOT = f"CASE WHEN part = 0 AND m < {PART} THEN ceil(log2(m)) ELSE {PART_BITS} END"


def _with_levels(parts: DataFrame) -> DataFrame:
    return parts.withColumn("m", F.size("h")).withColumn("levels", _levels_in(F.col("h")))


def _of_parts(parts: DataFrame, wanted: DataFrame | None, above: DataFrame | None, more: list[str]) -> DataFrame:
    """The parts that hold wanted leaves, with their levels and what is known of their roots: above (chain, idx, siblings, was_right, and ``more`` columns)."""
    if wanted is not None:
        parts = parts.join(wanted.groupBy("chain", F.expr(f"shiftright(idx, {PART_BITS})").alias("part")).agg(F.collect_set("idx").alias("asked")), ["chain", "part"])
    if above is not None:
        known = above.select("chain", F.col("idx").alias("part"), F.col("siblings").alias("further"), F.col("was_right").alias("further_right"), *[F.col(c).alias(f"of_{c}") for c in more])
        return _with_levels(parts.join(known, ["chain", "part"], "left"))
    none = {"further": "array<string>", "further_right": "array<boolean>"} | {f"of_{c}": "string" for c in more}
    return _with_levels(parts.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()}))


def _whole_paths(parts: DataFrame, steps: str, wanted: DataFrame | None, *more: Column) -> DataFrame:
    """chain, idx, hash, siblings, was_right and more: inside the part, and on from its root."""
    paths = _paths(parts, steps).withColumn("idx", F.col("part") * PART + F.col("j"))
    if wanted is not None:
        paths = paths.where(F.array_contains("asked", F.col("idx")))
    both = lambda x, further, kind: F.concat(x, F.coalesce(further, F.array().cast(kind)))
    return paths.select("chain", "idx", "hash", both("siblings", "further", "array<string>").alias("siblings"), both("was_right", "further_right", "array<boolean>").alias("was_right"), *more)


def prove_all(leaves: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """chain, idx, hash, siblings, was_right, root: the audit paths of all leaves, or of wanted ones (chain, idx).

    Stretches of PART leaves are a row each, in which their paths are found; the stretches' roots are the leaves of the next tree. So a leaf
    is shuffled once, whatever the height, and paths are not.
    """
    parts = _parts(leaves)
    # A full first part may be the whole chain; then the next tree is its root alone.
    above = durable(_with_levels(parts).where(f"part > 0 OR m = {PART}").select("chain", F.col("part").alias("idx"), F.expr("element_at(levels, -1)[0]").alias("hash")))
    met = _of_parts(parts, wanted, None if above.isEmpty() else prove_all(above), ["root"])
    own = F.expr(f"levels[cast({_TO_ROOT} as int)][0]")
    return _whole_paths(met.withColumn("root", F.coalesce("of_root", own)), _TO_ROOT, wanted, F.col("root"))


def prove_inclusion(leaves: DataFrame, wanted: DataFrame) -> DataFrame:
    """chain, idx, hash, siblings, was_right: audit paths of wanted leaves (chain, idx)."""
    return prove_all(leaves, wanted).drop("root")


def verify_inclusion(leaf: Column, siblings: Column, was_right: Column, root: Column) -> Column:
    """A leaf's hash folded with its siblings gives the root; was_right says that the folded node was the right child."""
    steps = F.arrays_zip(siblings.alias("sibling"), was_right.alias("was_right"))
    up = F.aggregate(steps, leaf, lambda h, s: F.when(s["was_right"], merkle_parent(s["sibling"], h)).otherwise(merkle_parent(h, s["sibling"])))
    return up == root


def mountain_peaks(leaves: DataFrame) -> DataFrame:
    """chain, height, hash, from_idx, to_idx: the peaks of each chain's mountain range.

    A binary counter's carries give one perfect tree for each set bit of the leaf count, the largest
    first. Leaves are assigned to their tree by arithmetic and each tree is built like any Merkle tree.
    """
    sizes = leaves.groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    bits = F.expr("filter(sequence(62, 0, -1), h -> shiftright(n, h) % 2 = 1)")
    spans = sizes.select("chain", "n", F.explode(bits).alias("height"))
    spans = spans.select("chain", "height", (F.col("n") - F.expr("n % cast(shiftleft(1L, height + 1) as bigint)")).alias("from_idx"), F.expr("shiftleft(1L, height)").alias("size"))
    met = leaves.join(spans, "chain").where((F.col("idx") >= F.col("from_idx")) & (F.col("idx") < F.col("from_idx") + F.col("size")))
    trees = met.select(F.struct("chain", "height", "from_idx", "size").alias("chain"), (F.col("idx") - F.col("from_idx")).alias("idx"), "hash")
    roots = merkle_levels(trees)[-1]
    return roots.select("chain.chain", "chain.height", "hash", "chain.from_idx", (F.col("chain.from_idx") + F.col("chain.size") - 1).alias("to_idx"))


def bag_peaks(peaks: DataFrame) -> DataFrame:
    """chain, root, leaf_count: the peaks folded from the lowest to the highest."""
    got = peaks.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("height", "hash"))).alias("p"), (F.max("to_idx") + 1).alias("leaf_count"))
    tail = F.slice("p", 2, F.size("p"))
    return got.select("chain", F.aggregate(tail, F.col("p")[0]["hash"], lambda acc, x: merkle_parent(acc, x["hash"])).alias("root"), "leaf_count")


def mountain_roots(leaves: DataFrame) -> DataFrame:
    return bag_peaks(mountain_peaks(leaves))


def root_at(leaves: DataFrame, last_idx: int) -> DataFrame:
    """The roots of the prefixes up to a leaf."""
    return mountain_roots(leaves.where(F.col("idx") <= last_idx))


def checkpoints(leaves: DataFrame, every: int = AUTO_CHECKPOINT) -> DataFrame:
    """chain, no, from_idx, to_idx, leaf_count, root, link: a Merkle root for each full stretch, linked to the one before."""
    cut = leaves.withColumn("no", F.floor(F.col("idx") / every)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("chain", "no"))).where(F.col("n") == every)
    trees = cut.select(F.struct("chain", "no").alias("chain"), (F.col("idx") % every).alias("idx"), "hash")
    roots = merkle_roots(trees).select("chain.chain", "chain.no", "root", "leaf_count")
    prev = F.lag("root").over(Window.partitionBy("chain").orderBy("no"))
    return roots.select("chain", "no", (F.col("no") * every).alias("from_idx"), (F.col("no") * every + every - 1).alias("to_idx"), "leaf_count", "root", checkpoint_link(prev, F.col("root")).alias("link"))


def verify_checkpoints(stored: DataFrame, leaves: DataFrame, every: int = AUTO_CHECKPOINT) -> DataFrame:
    """chain, no, verdict (ok, leaf_count, root, link) for stored checkpoints."""
    fresh = checkpoints(leaves, every).select("chain", "no", F.col("leaf_count").alias("n2"), F.col("root").alias("root2"))
    prev = F.lag("root").over(Window.partitionBy("chain").orderBy("no"))
    met = stored.withColumn("want", checkpoint_link(prev, F.col("root"))).join(fresh, ["chain", "no"], "left")
    verdict = F.when(F.coalesce("n2", F.lit(0)) != F.col("leaf_count"), "leaf_count").when(F.col("root2") != F.col("root"), "root").when(F.col("want") != F.col("link"), "link").otherwise("ok")
    return met.select("chain", "no", verdict.alias("verdict"))


def compare_checkpoints(old: DataFrame, new: DataFrame) -> DataFrame:
    """chain, verdict: seq_backwards, leaves_fell, rewritten (same length, other root), extended or same. Both: chain, to_idx, leaf_count, root."""
    n = new.select("chain", F.col("to_idx").alias("to2"), F.col("leaf_count").alias("n2"), F.col("root").alias("root2"))
    verdict = (F.when(F.col("to2") < F.col("to_idx"), "seq_backwards").when(F.col("n2") < F.col("leaf_count"), "leaves_fell")
               .when((F.col("n2") == F.col("leaf_count")) & (F.col("root2") != F.col("root")), "rewritten").when(F.col("n2") == F.col("leaf_count"), "same").otherwise("extended"))
    return old.join(n, "chain").select("chain", verdict.alias("verdict"))


def verify_anchors(anchors: DataFrame) -> DataFrame:
    """line, ok, reason (malformed, link, hash): each anchor's hash is taken again over the rest of its line, and it names the one before it.

    anchors: line, raw, entry (see the anchor source).
    """
    order = Window.orderBy("line")  # a log of checkpoints: one line for each, of one writer
    linked = anchors.withColumn("before", F.lag("entry.anchorHash").over(order)).withColumn("fresh", _anchor_hash("raw"))
    reason = F.when(F.col("entry").isNull(), "malformed").when(~F.col("entry.prevAnchorHash").eqNullSafe(F.col("before")), "link").when(~F.col("entry.anchorHash").eqNullSafe(F.col("fresh")), "hash")
    return linked.select("line", reason.isNull().alias("ok"), reason.alias("reason"))


@F.udf(T.StringType(), useArrow=True)
def _anchor_hash(raw: str) -> str | None:
    try:
        entry = json.loads(raw)
    except ValueError:
        return None
    return anchor(entry)["anchorHash"] if isinstance(entry, dict) else None


def prove_all_in_mountains(leaves: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """chain, idx, hash, siblings, was_right, peak, peaks, root: a path inside the leaf's peak, all peaks from the lowest, and what they bag to; of all leaves, or of wanted ones (chain, idx).

    A peak of height PART_BITS or more is made of whole stretches, which are the leaves of the next range; a lower one lies in the chain's last, partial stretch.
    """
    parts = _parts(leaves)
    above, peaks = _mountains_above(parts, 0)
    every = peaks.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("height", "hash"))), lambda p: p["hash"]).alias("peaks"))
    root = F.aggregate(F.slice("peaks", 2, F.size("peaks")), F.col("peaks")[0], lambda acc, p: merkle_parent(acc, p))
    met = parts.join(durable(every.withColumn("root", root)), "chain")
    return _mountain_paths(met, wanted, above, F.col("peaks"), F.col("root"))


def _mountains_above(parts: DataFrame, height: int) -> tuple[DataFrame | None, DataFrame]:
    """The paths of the full parts' roots in their ranges, if there are any, and all peaks (chain, height, hash); the parts' leaves are nodes of ``height``."""
    raised = _with_levels(parts)
    bits = f"filter(sequence(0, {PART_BITS - 1}), k -> shiftright(m, k) % 2 = 1)"
    low = f"transform({bits}, k -> named_struct('height', k + {height}, 'hash', levels[k][2 * shiftright(m, k + 1)]))"
    peaks = durable(raised.where(f"m < {PART}").select("chain", F.expr(f"inline({low})")))
    full = durable(raised.where(f"m = {PART}").select("chain", F.col("part").alias("idx"), F.expr("element_at(levels, -1)[0]").alias("hash")))
    if full.isEmpty():
        return None, peaks
    higher = _parts(full)
    above, more = _mountains_above(higher, height + PART_BITS)
    return _mountain_paths(higher, None, above), peaks.unionByName(more)


def _mountain_paths(parts: DataFrame, wanted: DataFrame | None, above: DataFrame | None, *more: Column) -> DataFrame:
    met = _of_parts(parts, wanted, above, ["peak"])
    # The leaf's peak is as high as the highest bit in which its place and the number of leaves differ.
    steps = f"CASE WHEN m = {PART} THEN {PART_BITS} ELSE floor(log2(j ^ m)) END"
    low = F.expr(f"transform(sequence(0, {PART_BITS - 1}), k -> get(levels[k], cast(2 * shiftright(m, k + 1) as int)))")
    peak = F.coalesce("of_peak", F.get("low", F.size(F.col("siblings"))))
    return _whole_paths(met.withColumn("low", low), steps, wanted, peak.alias("peak"), *more)


def prove_in_mountains(leaves: DataFrame, wanted: DataFrame) -> DataFrame:
    """chain, idx, hash, siblings, was_right, peak, peaks of wanted leaves (chain, idx); see ``prove_all_in_mountains``."""
    return prove_all_in_mountains(leaves, wanted).drop("root")


def verify_in_mountains(leaf: Column, siblings: Column, was_right: Column, peak: Column, peaks: Column, root: Column) -> Column:
    """The path gives the peak, the peak is one of the peaks, and the peaks bag to the root."""
    bagged = F.aggregate(F.slice(peaks, 2, F.size(peaks)), F.get(peaks, F.lit(0)), lambda acc, p: merkle_parent(acc, p))
    return verify_inclusion(leaf, siblings, was_right, peak) & F.array_contains(peaks, peak) & (bagged == root)


def file_roots(chunks: DataFrame) -> DataFrame:
    """path, root: a Merkle root for each code file, over its named parts by their first line, or over all if it has none. chunks: path, kind, start_line, snapshot_hash."""
    named = chunks.withColumn("named", F.max((F.col("kind") != "file").cast("int")).over(Window.partitionBy("path")))
    used = named.where((F.col("kind") != "file") | (F.col("named") == 0))
    order = Window.partitionBy("path").orderBy("start_line", "snapshot_hash")
    leaves = used.select(F.col("path").alias("chain"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.col("snapshot_hash").alias("hash"))
    return merkle_roots(leaves).select(F.col("chain").alias("path"), "root")
