"""Mountain ranges that grow: stored nodes of many chains, appended to without reading old leaves.

A node of height h and place i covers the leaves [i * 2^h, (i + 1) * 2^h). It never changes once its leaves are there, so a range
is a table of nodes that only grows. A prefix of n leaves is covered by one node for each set bit of n, its peaks. So an append
joins new leaves with the stored peaks alone, and the roots of any number of prefixes, for checkpoints or for receipts
kept from earlier, come from one join on (chain, height, place).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import checkpoint_link, merkle_parent
from ..materialise import durable
from .chains import AUTO_CHECKPOINT, PART, PART_BITS
from .ordered import counted_upto, numbered


def cover(prefixes: DataFrame, size: str = "leaf_count") -> DataFrame:
    """The rows with ``height`` and ``place`` of each node that covers the first ``size`` leaves; a row without leaves gives none."""
    heights = prefixes.withColumn("height", F.explode(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda h: F.call_function("shiftright", F.col(size), h) % 2 == 1)))
    return heights.withColumn("place", F.expr(f"shiftleft(shiftright({size}, height + 1), 1)"))


def append_leaves(peaks: DataFrame, leaves: DataFrame) -> DataFrame:
    """The new nodes (chain, height, place, hash), leaves included. peaks: chain, height, place, hash of what is stored; leaves: chain, seq, hash.

    Leaves go on behind those the peaks cover, in the order of seq. Stretches of PART nodes are a row each, in which the nodes above them are
    found together with the stored peaks of those heights; whole stretches are the leaves of the next round. So a leaf is shuffled once
    whatever the height, and the work grows with the new leaves. What is returned is written already.
    """
    sizes = peaks.groupBy("chain").agg(F.sum(F.expr("shiftleft(1L, height)")).alias("stored"))
    new = numbered(leaves, ["chain"], "seq", "nth").join(sizes, "chain", "left")
    level, height, out = new.select("chain", (F.coalesce("stored", F.lit(0)) + F.col("nth")).alias("place"), "hash"), 0, []
    while True:
        nodes = durable(_nodes_above(level, peaks, height))
        height += PART_BITS
        out.append(nodes.where(F.col("height") < height))
        level = nodes.where(F.col("height") == height).select("chain", "place", "hash")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)


def _nodes_above(level: DataFrame, peaks: DataFrame, height: int) -> DataFrame:
    """chain, height, place, hash: the new nodes (chain, place, hash) of ``height`` and those over them, up to PART_BITS higher."""
    here = level.select("chain", F.expr(f"shiftright(place, {PART_BITS})").alias("part"), F.lit(-1).alias("k"), "place", "hash")
    k = F.col("height") - height
    old = peaks.where((k >= 0) & (k < PART_BITS)).select("chain", F.call_function("shiftright", F.col("place"), PART_BITS - k).alias("part"), k.cast("int").alias("k"), "place", "hash")
    parts = here.unionByName(old).groupBy("chain", "part").agg(
        F.array_sort(F.collect_list(F.when(F.col("k") < 0, F.struct("place", "hash")))).alias("new"), F.map_from_entries(F.collect_list(F.when(F.col("k") >= 0, F.struct("k", "hash")))).alias("old")
    )
    # A level's new nodes stand side by side; where the first is a right one, its left one is a stored peak.
    pairs = "transform(slice(sequence(0, {last}), 1, cast(size(both) div 2 as int)), i -> sha2(concat(both[2 * i], both[2 * i + 1]), 256))".format(last=PART // 2 - 1)
    up = f"""named_struct('s', shiftright(element_at(levels, -1).s, 1), 'h', element_at(transform(array(
        CASE WHEN element_at(levels, -1).s % 2 = 1 AND size(element_at(levels, -1).h) > 0 THEN concat(array(old[k]), element_at(levels, -1).h) ELSE element_at(levels, -1).h END), both -> {pairs}), 1))"""
    levels = f"aggregate(sequence(0, {PART_BITS - 1}), array(named_struct('s', new[0].place, 'h', new.hash)), (levels, k) -> concat(levels, array({up})))"
    nodes = f"flatten(transform({levels}, (l, k) -> transform(l.h, (x, i) -> named_struct('height', k + {height}, 'place', l.s + i, 'hash', x))))"
    return parts.where("size(new) > 0").select("chain", F.expr(f"inline({nodes})"))


def peaks_after(peaks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The peaks (chain, height, place, hash) once ``nodes`` have been appended to a range with ``peaks``."""
    all_of = peaks.unionByName(nodes)
    old = peaks.groupBy("chain").agg(F.sum(F.expr("shiftleft(1L, height)")).alias("n"))
    new = nodes.where("height = 0").groupBy("chain").agg(F.count(F.lit(1)).alias("n"))
    sizes = old.unionByName(new).groupBy("chain").agg(F.sum("n").alias("leaf_count"))
    return all_of.join(cover(sizes).select("chain", "height", "place"), ["chain", "height", "place"], "left_semi")


def sync(peaks: DataFrame, entries: DataFrame, last_seq: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new nodes, peaks after them): catching up with the entries (chain, seq, hash) behind each chain's ``last_seq`` (chain, seq)."""
    if last_seq is not None:
        done = last_seq.select("chain", F.col("seq").alias("done"))
        entries = entries.join(done, "chain", "left").where(F.col("done").isNull() | (F.col("seq") > F.col("done"))).drop("done")
    nodes = append_leaves(peaks, entries)
    return nodes, durable(peaks_after(peaks, nodes))


def prefix_roots(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The prefixes (chain, leaf_count) with their ``root``, peaks bagged from the lowest to the highest; null where a node is missing."""
    asked = prefixes.select("chain", "leaf_count").distinct()
    met = cover(asked).join(nodes, ["chain", "height", "place"], "left").groupBy("chain", "leaf_count").agg(
        F.array_sort(F.collect_list(F.struct("height", "hash"))).alias("p"), F.count("hash").alias("n"), F.count(F.lit(1)).alias("asked")
    )  # at most one row a bit
    bagged = F.aggregate(F.slice("p", 2, F.size("p")), F.col("p")[0]["hash"], lambda acc, x: merkle_parent(acc, x["hash"]))
    return prefixes.join(met.where("n = asked").select("chain", "leaf_count", bagged.alias("root")), ["chain", "leaf_count"], "left")


def auto_checkpoints(nodes: DataFrame, every: int = AUTO_CHECKPOINT, after: DataFrame | None = None) -> DataFrame:
    """chain, leaf_count, root, link: a checkpoint of the whole range whenever ``every`` leaves have come, linked to the one before.

    after: the newest stored checkpoints (chain, leaf_count, root); only later ones are given, and the first links to it.
    """
    sizes = nodes.where("height = 0").groupBy("chain").agg((F.max("place") + 1).alias("size"))
    if after is not None:
        sizes = sizes.join(after.select("chain", F.col("leaf_count").alias("done"), F.col("root").alias("last")), "chain", "left")
    else:
        sizes = sizes.withColumn("done", F.lit(0).cast("long")).withColumn("last", F.lit(None).cast("string"))
    first = F.floor(F.coalesce("done", F.lit(0)) / every) + 1
    wanted = sizes.withColumn("n", F.floor(F.col("size") / every)).where(F.col("n") >= first).select("chain", "last", F.explode(F.transform(F.sequence(first, F.col("n")), lambda k: k * every)).alias("leaf_count"))
    roots = prefix_roots(nodes, wanted)
    prev = F.lag("root").over(Window.partitionBy("chain").orderBy("leaf_count"))  # one row for each ``every`` leaves
    return roots.select("chain", "leaf_count", "root", checkpoint_link(F.coalesce(prev, F.col("last")), F.col("root")).alias("link"))


def verify_prefixes(receipts: DataFrame, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """The receipts (chain, last_seq, leaf_count, root, ...) with ``verdict``: whether the chain as it stands still holds what they attested.

    ok; none_left: no entry up to last_seq remains; fewer: less than the attested number remain; rewritten: they hash to another root. A receipt
    without a root attested an empty chain, and is ok. A truncation that was followed by fresh writes shows as well: the earlier root is taken
    again from the nodes (chain, height, place, hash) of the entries (chain, seq) as they are now.
    """
    fixed = receipts.withColumn("__receipt", F.monotonically_increasing_id())
    fixed = durable(fixed)
    now = counted_upto(entries, ["chain"], "seq", fixed.where("root IS NOT NULL AND last_seq IS NOT NULL").select("__receipt", "chain", "last_seq"), "last_seq", "n_now")
    fresh = prefix_roots(nodes, now.select("chain", F.col("n_now").alias("leaf_count"))).distinct().select("chain", F.col("leaf_count").alias("n_now"), F.col("root").alias("root_now"))
    met = fixed.join(now.select("__receipt", "n_now"), "__receipt", "left").join(fresh, ["chain", "n_now"], "left")
    return met.withColumn("verdict", _prefix_verdict()).select(*receipts.columns, "verdict")


def _prefix_verdict() -> Column:
    return (
        F.when(F.col("n_now").isNull(), "ok").when(F.col("n_now") == 0, "none_left").when(F.col("n_now") < F.col("leaf_count"), "fewer")
        .when(~F.col("root_now").eqNullSafe(F.col("root")), "rewritten").otherwise("ok")
    )


def verify_against(anchored: DataFrame, current: DataFrame, entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """chain, ok, anchors, failed_at, reason: every anchored receipt (chain, no, last_seq, leaf_count, root) against the chain as it stands.

    current: chain, last_seq, leaf_count, root, audit_ok. All anchors count, not the newest: whoever truncates and anchors anew owns
    the newest. The first that fails is named; its reason is audit, seq_backwards, leaves_fell, same_length_other_root, or that of ``verify_prefixes``.
    """
    now = current.select("chain", F.coalesce("last_seq", F.lit(0)).alias("seq2"), F.col("leaf_count").alias("n2"), F.col("root").alias("root2"), "audit_ok")
    met = verify_prefixes(anchored, entries, nodes).join(now, "chain")
    seq = F.coalesce("last_seq", F.lit(0))
    reason = (
        F.when(~F.col("audit_ok"), "audit").when(F.col("seq2") < seq, "seq_backwards").when(F.col("n2") < F.col("leaf_count"), "leaves_fell")
        .when((F.col("seq2") == seq) & F.col("root").isNotNull() & ~F.col("root2").eqNullSafe(F.col("root")), "same_length_other_root").when(F.col("verdict") != "ok", F.col("verdict"))
    )
    bad = F.min(F.when(reason.isNotNull(), F.struct("no", reason.alias("reason"))))
    return met.groupBy("chain").agg(F.count(F.lit(1)).alias("anchors"), bad.alias("bad")).select("chain", F.col("bad").isNull().alias("ok"), "anchors", F.col("bad.no").alias("failed_at"), F.col("bad.reason").alias("reason"))
