"""Exact n-gram Jaccard self-join by vertical partitioning.

Every document becomes the set of its distinct shingles' hashes. The global n-gram order puts rare shingles first:
what is common comes last, the most frequent at the end, and all others stand in the order of their hashes. Common is
what many documents of a bounded sample hold, and what then still heads the order of more than ``DIRECT_GROUP``
documents of all, up to ``MOST_COMMON`` shingles. The order bears on speed only, never on results.

Who meets. Sets that reach a Jaccard similarity of t share one of the first n - ceil(tn) + 1 shingles of the larger
and of the first n - ceil(2tn / (1 + t)) + 1 of the smaller one (the prefix filter of Xiao et al. 2008). Their sizes differ by a
factor of t at most, so a key is a shingle and a class of sizes, each class that factor wide: a set shows its first shingles in its
own class, and those for a larger partner in the next one. So a shingle that many documents hold is many keys. Of the pairs that meet, only those are counted whose sizes and parity signatures allow for a link: a signature has ``SIGNATURE_BITS``
bits, each the parity of the shingles that fall on it, so two of them differ in at most as many bits as the sets
differ in shingles.

Counting. The global order is cut into ``COUNT_FRAGMENTS`` stretches: the common shingles at its end are one, the others
equal stretches of the hashes. The segments of pairs are joined fragment by fragment; each fragment gives a partial overlap per
pair, and the partial overlaps are summed per pair and held against the threshold.

Large groups. Where at most ``DIRECT_GROUP`` documents meet on a shingle, their pairs are counted by that join. In larger
groups each member is counted with the first one; where these put all members into one component, nothing is
left to compare. Of the other groups' members only those stay that may still link: where too many of a set's shingles are in no other
member of any of these groups, it reaches the threshold with none. Groups whose first ones are in one component are taken together where that is fewer pairs than
those of each group. Up to ``BLOCK_GROUP`` members are then dealt into blocks of bounded size, and each pair of blocks is one
small task that sums the partial overlaps of its documents as products of incidence matrices, fragment by fragment, and
returns the links that join what is not in one component yet. So no task holds a whole group, and the pairs of a large group are never rows.

Members of groups beyond that meet once more, with the frequencies among these members as the order: copies
that were each edited too much to link share no shingle so rare. There up to ``SMALL_GROUP`` are paired. Of a group that is still large, pairs with its leader come
first; what these leave in several components is dealt into blocks, whatever its size.

Copies (equal sets) are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import bounded_batches, durable, quoted, with_maybe
from ._shingles import chunks, mix, shingle_sets
from .components import connected_further, rooted

SHINGLE = 3
THRESHOLD = Fraction(90, 100)
#: The sample that tells common shingles: documents, the least of them to hold a common one; and the most common ones kept.
SAMPLE_DOCS, SAMPLE_LEAST, MOST_COMMON = 4000, 3, 200_000
SIGNATURE_BITS = 2048
COUNT_FRAGMENTS = 8
#: Documents that meet on a shingle in the first round and are paired at once; in the second round, among members of larger groups.
DIRECT_GROUP, SMALL_GROUP = 64, 64
#: Members of a group that go into blocks without another round; nodes and shingles of a block.
BLOCK_GROUP = 4096
BLOCK_NODES = 128
BLOCK_SHINGLES = 150_000
#: Shingles whose holders one task counts, about.
STRETCH_SHINGLES = 1 << 20
_U = np.uint64


def prefix_lengths(n: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """How many of its first shingles a set of each size shows as the larger one of a pair, and as the smaller one."""
    p, q = threshold.numerator, threshold.denominator
    return n + (-n * p) // q + 1, n + (-2 * n * p) // (p + q) + 1


def signatures(g: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row for each set: SIGNATURE_BITS parities in numbers of 64 bits."""
    words = SIGNATURE_BITS // 64
    spot = mix(g ^ _U(0xA24BAED4963EE407)) % _U(SIGNATURE_BITS)
    out = np.zeros(len(sizes) * words, dtype=np.uint64)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(sizes)), sizes) * words + (spot >> _U(6)).astype(np.int64), _U(1) << (spot & _U(63)))
    return out.reshape(len(sizes), words)


def node_ids(g: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set, equal for equal sets."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(mix(g ^ _U(0x5851F42D4C957F2D)), (np.cumsum(sizes) - sizes)[full])
    return mix(out + sizes.astype(np.uint64))


def lists_of(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(values.view(np.int64)))


def _shingles(k: int, first=None):
    """text -> shingle: each distinct one of each text; with ``first`` (a threshold and common shingles) those of its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(0).cast(pa.binary())):
                g, sizes = shingle_sets(texts, k)
                if first is not None:
                    g, _ = first_shingles(g, sizes, first[1].value, np.where(sizes > 0, prefix_lengths(sizes, first[0])[0], 0))
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], names=["shingle"])

    return run


def _common(rows: DataFrame, threshold: Fraction, k: int):
    """The common shingles, sorted, and about how many documents hold each, as a broadcast of at most 2 x MOST_COMMON. rows: doc_id, text."""
    sc, n = rows.sparkSession.sparkContext, rows.count()

    def most(texts: DataFrame, least: int, first=None) -> tuple[np.ndarray, np.ndarray]:
        counts = texts.mapInArrow(_shingles(k, first), "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        got = counts.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).toArrow()
        return got.column("shingle").to_numpy().astype(np.int64).view(np.uint64), got.column("n").to_numpy().astype(np.int64)

    place = F.xxhash64("doc_id", F.xxhash64(F.col("doc_id").cast("string"))).cast("double") / 2.0**64 + 0.5
    sample = rows.where((place <= SAMPLE_DOCS / n) | F.col("doc_id").isNull()).select("text").limit(2 * SAMPLE_DOCS) if n > SAMPLE_DOCS else rows.select("text")
    of_sample, held = most(sample, SAMPLE_LEAST)
    held = held * max(n // SAMPLE_DOCS, 1)
    order = np.argsort(of_sample)
    more, shown = most(rows.select("text"), DIRECT_GROUP + 1, (threshold, sc.broadcast((of_sample[order], held[order]))))
    shingles, at = np.unique(np.concatenate((of_sample, more)), return_index=True)
    return sc.broadcast((shingles, np.concatenate((held, shown))[at]))


def first_shingles(g: np.ndarray, sizes: np.ndarray, common: tuple[np.ndarray, np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set in the global order, as many as ``lengths`` says, and the place of each in its set."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    shingles, n = common
    weight = np.zeros(len(g), dtype=np.int64)
    if len(shingles):
        at = np.minimum(np.searchsorted(shingles, g), len(shingles) - 1)
        weight = np.where(shingles[at] == g, n[at], 0)
    order = np.argsort(which * (int(weight.max(initial=0)) + 1) + weight, kind="stable")  # g is sorted within each set
    place = np.arange(len(g)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    taken = place < lengths[which]
    return g[order][taken], place[taken]


def _sign(k: int):
    """doc_id, digest, text -> doc_id, digest, n_shingles, node, signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in chunks(batch.column(2).cast(pa.binary())):
                g, sizes = shingle_sets(texts, k)
                signs = signatures(g, sizes)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, len(texts)) for c in (0, 1)), pa.array(sizes.astype(np.int64)), pa.array(node_ids(g, sizes).view(np.int64)), lists_of(signs.ravel(), np.full(len(sizes), signs.shape[1]))], names=["doc_id", "digest", "n_shingles", "node", "signature"])

    return run


def size_class(n: np.ndarray, threshold: Fraction) -> np.ndarray:
    """Classes of set sizes: two sets that may link are in one class or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / (np.log(float(1 / threshold)) * (1 + 1e-9))).astype(np.int64)


def keys_of(g: np.ndarray, sizes: np.ndarray, common: tuple[np.ndarray, np.ndarray], threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, role) of all sets: role is four times the size, two more in the set's own class, one more where the shingle is in its prefix as the smaller one."""
    long, short = prefix_lengths(sizes, threshold)
    long, of = np.where(sizes > 0, long, 0), size_class(sizes, threshold)
    shingles, place = first_shingles(g, sizes, common, long)
    which = np.repeat(np.arange(len(sizes)), long)
    small = place < short[which]
    own = mix(shingles + of[which].astype(np.uint64) * _U(0x9E6C63D0876A9A35))
    above = mix(shingles + (of[which] + 1).astype(np.uint64) * _U(0x9E6C63D0876A9A35))[small]
    return np.concatenate((which, which[small])), np.concatenate((own, above)), np.concatenate((4 * sizes[which] + 2 + small, 4 * sizes[which][small] + 1))


def _keys(threshold: Fraction, k: int, shared):
    """text -> key, node, role (see ``keys_of``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for _, texts in chunks(batch.column(0).cast(pa.binary())):
                g, sizes = shingle_sets(texts, k)
                which, keys, role = keys_of(g, sizes, common, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(node_ids(g, sizes).view(np.int64)[which]), pa.array(role.astype(np.int64))], names=["key", "node", "role"])

    return run


def fragment_of(g: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The stretch of the global order that each shingle lies in; the sorted ``common`` ones, which end the order, lie in the last."""
    f = ((g >> _U(32)) * _U(COUNT_FRAGMENTS - 1) >> _U(32)).astype(np.int64)
    if len(common):
        f[common[np.minimum(np.searchsorted(common, g), len(common) - 1)] == g] = COUNT_FRAGMENTS - 1
    return f


def _segments(k: int, shared=None):
    """doc_id, text -> node, f, n (size of the whole set), part (its shingles in fragment f, sorted); fragments without any give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value[0] if shared is not None else np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for _, texts in chunks(batch.column(0).cast(pa.binary())):
                g, sizes = shingle_sets(texts, k)
                nodes = node_ids(g, sizes).view(np.int64)
                place = np.repeat(np.arange(len(texts)), sizes) * COUNT_FRAGMENTS + fragment_of(g, common)
                order = np.argsort(place, kind="stable")
                g = g[order]
                counts = np.bincount(place, minlength=len(texts) * COUNT_FRAGMENTS)
                at = np.flatnonzero(counts)
                which, f = at // COUNT_FRAGMENTS, (at % COUNT_FRAGMENTS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[which]), pa.array(f), pa.array(sizes[which].astype(np.int64)), lists_of(g, counts[at])], names=["node", "f", "n", "part"])

    return run


def pair_sets(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, shared=None) -> DataFrame:
    """``sets_of`` the nodes that pairs (a, b) name."""
    named = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return sets_of(named, nodes, rows, k, shared)


def sets_of(some: DataFrame, nodes: DataFrame, rows: DataFrame, k: int, shared=None) -> DataFrame:
    """node, f, n, part of the nodes ``some`` (node), and of few others; one row for each node and fragment.

    Not written: the joins that count overlaps read the exchange by node and f, both sides the same one. nodes: node, rep
    (id of a row that has the set), digest (of that row's text); rows: doc_id, digest, text. Rows of a repeated id
    and other texts are told apart by the digest.
    """
    wanted = durable(nodes.join(some, "node", "left_semi").select(F.xxhash64("rep", "digest").alias("row")))
    near = with_maybe(rows, F.xxhash64("doc_id", "digest"), wanted).where("__maybe").select("text")
    segments = near.mapInArrow(_segments(k, shared), "node long, f int, n long, part array<long>")
    return segments.groupBy("node", "f").agg(F.first("n").alias("n"), F.first("part").alias("part"))


def may_link(n_a, n_b, threshold: Fraction):
    """Whether the sizes alone allow for a link."""
    t = threshold
    return t.denominator * F.least(n_a, n_b) >= t.numerator * F.greatest(n_a, n_b)


def _not_too_different(pairs: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow for a link. nodes: node, n, signature."""
    about = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    met = pairs.join(about("a"), "a").join(about("b"), "b")
    differ = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    t = threshold
    return met.where(may_link(F.col("n_a"), F.col("n_b"), t) & ((t.numerator + t.denominator) * differ <= (t.denominator - t.numerator) * (F.col("n_a") + F.col("n_b")))).select("a", "b")


def pairs_that_link(pairs: DataFrame, segments: DataFrame, threshold: Fraction) -> DataFrame:
    """a, b of the pairs whose sets reach the threshold. pairs: a, b (nodes); segments: node, f, n, part, dealt by node and f."""
    each = pairs.withColumn("f", F.explode(F.expr(f"sequence(0, {COUNT_FRAGMENTS - 1})")))
    left = each.join(segments.select(F.col("node").alias("a"), "f", F.col("n").alias("n_a"), F.col("part").alias("part_a")), ["a", "f"])
    met = left.join(segments.select(F.col("node").alias("b"), "f", F.col("n").alias("n_b"), F.col("part").alias("part_b")), ["b", "f"])
    partial = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("part_a", "part_b")).alias("both"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    t = threshold
    return summed.where(t.denominator * F.col("both") >= t.numerator * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _pairs_in_groups(members: DataFrame, threshold: Fraction) -> DataFrame:
    """a, b: the pairs that meet on a shingle which few documents show. members: key, node, role."""
    groups = members.groupBy("key").agg(F.collect_set(F.struct("node", "role")).alias("m"))
    size, indexed, own = lambda x: F.shiftright(x["role"], 2), lambda x: x["role"] % 2 == 1, lambda x: x["role"] % 4 > 1
    meets = lambda x, y: (x["node"] < y["node"]) & (own(x) | own(y)) & may_link(size(x), size(y), threshold) & (((size(x) <= size(y)) & indexed(x)) | ((size(y) <= size(x)) & indexed(y)))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: meets(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _prefixes(segments: DataFrame, threshold: Fraction) -> DataFrame:
    """key, node, role: the prefix of each set of ``segments``, in the order of the frequencies among these sets."""
    mine = segments.select("node", "n", F.explode("part").alias("key"))
    known = mine.join(mine.groupBy("key").agg(F.count(F.lit(1)).alias("df")), "key")
    t = threshold
    length = lambda p, q: (F.col("n") - F.ceil(F.col("n") * p / q - 1e-9) + 1).cast("int")
    rarest = known.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("order"))
    shown = rarest.select("node", "n", F.posexplode(F.slice("order", 1, length(t.numerator, t.denominator))).alias("at", "x"))
    return shown.where("x.df > 1").select("x.key", "node", (4 * F.col("n") + 2 + (F.col("at") < length(2 * t.numerator, t.numerator + t.denominator)).cast("long")).alias("role"))


def settled(large: DataFrame, maps: list[DataFrame], rows: DataFrame, nodes: DataFrame, threshold: Fraction, k: int, shared=None, parity: bool = True) -> list[DataFrame]:
    """The maps and further ones, once all members of large groups (key, node) have met that the maps leave in several components.

    The leaders' pairs are in the maps. rows, nodes: as in ``sets_of``; parity: whether the nodes' signatures are those of ``signatures``.
    """
    still = durable(still_mixed(large, maps).select("key", "node"))
    if still.isEmpty():
        return maps
    some = durable(still.select("node").distinct())
    segments = durable(sets_of(some, nodes, rows, k, shared).join(some, "node", "left_semi"))
    able = durable(still.join(may_link_any(segments, threshold), "node", "left_semi"))
    groups = durable(mixed_groups(able, maps))
    if groups.isEmpty():
        return maps
    few, many = groups.where(F.col("members") <= BLOCK_GROUP), groups.where(F.col("members") > BLOCK_GROUP)
    if not few.isEmpty():
        maps = connected_further(maps, durable(_links_in_blocks(few, segments, threshold)))
    if many.isEmpty():
        return maps
    again = durable(segments.join(many.select("node").distinct(), "node", "left_semi"))
    return _met_again(again, nodes if parity else durable(parity_signatures(again)), threshold, maps)


def may_link_any(segments: DataFrame, threshold: Fraction) -> DataFrame:
    """node: those of ``segments`` that share enough shingles with all others together to link with one of them.

    Shingles are dealt by stretches of their hashes, as lists: each task of ``segments`` gives one row for each batch and stretch, in
    which what several sets hold stands once, without them. So a shingle is never a row, and a very common one is as many entries as there are batches.
    """
    total = segments.agg(F.sum(F.size("part"))).first()[0] or 0
    held = segments.select("node", "part").mapInArrow(_held(-(-total // STRETCH_SHINGLES)), "stretch int, shingle array<long>, node array<long>, shared array<long>")
    alone = held.groupBy("stretch").applyInArrow(_held_alone, "node long, alone long").groupBy("node").agg(F.sum("alone").alias("alone"))
    met = segments.select("node", "n").distinct().join(alone, "node", "left")
    t = threshold
    return met.where(t.denominator * (F.col("n") - F.coalesce("alone", F.lit(0))) >= t.numerator * F.col("n")).select("node")


def _held(stretches: int):
    """node, part -> stretch, shingle and node (what one set of the batch holds, and which), shared (what several hold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1)
            node = np.repeat(batch.column(0).to_numpy(), np.diff(parts.offsets.to_numpy()))
            g, at, times = np.unique(parts.flatten().to_numpy().view(np.uint64), return_index=True, return_counts=True)
            stretch, one = ((g >> _U(32)) * _U(stretches) >> _U(32)).astype(np.int64), times == 1
            counts, shared = (np.bincount(stretch[x], minlength=stretches) for x in (one, ~one))
            rows = [pa.array(np.arange(stretches, dtype=np.int32)), lists_of(g[one], counts), lists_of(node[at[one]], counts), lists_of(g[~one], shared)]
            yield pa.RecordBatch.from_arrays(rows, names=["stretch", "shingle", "node", "shared"])

    return run


def _held_alone(table: pa.Table) -> pa.Table:
    """One stretch, as ``_held`` gives it -> node, alone (how many of these shingles only this set holds)."""
    table = table.combine_chunks()
    shingles, nodes, shared = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("shingle", "node", "shared"))
    _, at, times = np.unique(shingles, return_index=True, return_counts=True)
    once = at[times == 1]
    node, alone = np.unique(nodes[once[~np.isin(shingles[once], shared)]], return_counts=True)
    return pa.table({"node": node, "alone": alone.astype(np.int64)})


def _met_again(segments: DataFrame, nodes: DataFrame, threshold: Fraction, maps: list[DataFrame]) -> list[DataFrame]:
    """The maps and further ones, once the sets of ``segments`` have met in the order of the frequencies among them."""
    keys = durable(_prefixes(segments, threshold))
    counted = keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("leader")), "key")
    large = durable(counted.where(F.col("members") > SMALL_GROUP).select("key", "node", "members", "leader"))
    led = large.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = _pairs_in_groups(counted.where(F.col("members") <= SMALL_GROUP), threshold).unionByName(led).distinct()
    maps = connected_further(maps, durable(pairs_that_link(durable(_not_too_different(pairs, nodes, threshold)), segments, threshold)))
    if large.isEmpty():
        return maps
    groups = durable(mixed_groups(large, maps))
    return maps if groups.isEmpty() else connected_further(maps, durable(_links_in_blocks(groups, segments, threshold)))


def mixed_groups(large: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """key, node, members, root: the groups of ``large`` (key, node) with members of several components, as few as cover them.

    Groups whose leaders (smallest nodes) are in one component are one group where its pairs are no more than those of all of them; a larger
    group compares more, never less. A leader's component is looked up once for each group and for each node that it leads, not
    for each member of each group.
    """
    still = durable(still_mixed(large, maps))
    root = durable(rooted(still.select("node").distinct(), maps))
    whole = root.select(F.col("node").alias("leader"), F.col("root").alias("whole"))
    keys = durable(still.groupBy("key", "leader", "members").agg(F.lit(1).alias("one")).join(whole, "leader"))  # one row a group
    together = durable(still.select("leader", "node").distinct().join(whole, "leader").select("whole", "node").distinct())
    apart = keys.groupBy("whole").agg(F.sum(F.col("members") * F.col("members")).alias("squares"))
    fewer = durable(together.groupBy("whole").agg(F.count(F.lit(1)).alias("all")).join(apart, "whole").select("whole", "all", (F.col("all") * F.col("all") <= F.col("squares")).alias("joined")))
    of_whole = together.join(fewer.where("joined"), "whole").select(F.col("whole").alias("key"), "node", F.col("all").alias("members"))
    alone = keys.join(fewer.where("NOT joined"), "whole", "left_semi").select("key")
    return of_whole.unionByName(still.join(alone, "key", "left_semi").select("key", "node", "members")).join(root, "node")


def parity_signatures(segments: DataFrame) -> DataFrame:
    """node, n, signature of the sets whose segments these are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            signs = signatures(batch.column(2).flatten().to_numpy().view(np.uint64), sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists_of(signs.ravel(), np.full(len(sizes), signs.shape[1]))], names=["node", "n", "signature"])

    each = segments.select("node", "n", "part").mapInArrow(run, "node long, n long, signature array<long>").groupBy("node", "n").agg(F.collect_list("signature").alias("all"))
    none = F.array_repeat(F.lit(0).cast("long"), SIGNATURE_BITS // 64)
    return each.select("node", "n", F.aggregate("all", none, lambda x, y: F.zip_with(x, y, lambda i, j: i.bitwiseXOR(j))).alias("signature"))  # one for each fragment


def _links_in_blocks(groups: DataFrame, segments: DataFrame, threshold: Fraction) -> DataFrame:
    """a, b: links that connect what is connected within each group and not of one root. groups: key, node, members (how many nodes the key has), root."""
    whole = segments.groupBy("node", "n").agg(F.collect_list(F.struct("f", "part")).alias("parts"))
    rows = durable(whole.join(groups, "node"))
    sizes = rows.groupBy("key").agg(F.greatest(F.ceil(F.max("members") / BLOCK_NODES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "root", "n", "parts")
    return met.groupBy("key", "i", "j").applyInArrow(_block_links(threshold), "a long, b long")


def _block_links(threshold: Fraction):
    t = threshold

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        _, first, root = np.unique(table.column("root").to_numpy(), return_index=True, return_inverse=True)
        rows = table.column("parts").combine_chunks()
        each = rows.flatten()
        seat_of = np.repeat(np.arange(len(nodes)), np.diff(rows.offsets.to_numpy()))
        fragment, parts = each.field("f").to_numpy(), each.field("part")
        both = np.zeros((len(nodes), len(nodes)), dtype=np.float32)
        for f in range(COUNT_FRAGMENTS if len(first) > 1 else 0):  # the partial overlaps of each fragment, summed per pair
            mine = np.flatnonzero(fragment == f)
            if not len(mine):
                continue
            lists = parts.take(pa.array(mine))
            owner = np.repeat(seat_of[mine], np.diff(lists.offsets.to_numpy()))
            _, column, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
            seat = np.cumsum(times > 1) - 1
            again = times[column] > 1
            part = np.zeros((len(nodes), int(seat[-1]) + 1), dtype=np.float32)
            part[owner[again], seat[column[again]]] = 1
            both += part @ part.T
        linked = (t.denominator * both >= t.numerator * (n[:, None] + n[None, :] - both)) | (root[:, None] == root[None, :])
        label, before = np.arange(len(nodes)), None
        while before is None or (label != before).any():
            before, label = label, np.where(linked, label[None, :], len(nodes)).min(axis=1)
        tied = first[label[first] != first]  # one link for each root that another one takes in
        return pa.table({"a": nodes[label[tied]], "b": nodes[tied]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def with_component(signed: DataFrame, nodes: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """doc_id, digest, n_shingles, component_id. signed: doc_id, digest, n_shingles, node; nodes: node, rep; maps: of the linked nodes to their roots."""
    named = durable(rooted(nodes.select("node", "rep"), maps))
    of_root = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_node = named.join(of_root, "root").select("node", "component_id")
    return signed.select("doc_id", "digest", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", "digest", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def still_mixed(large: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """key, node, members, leader: the rows of ``large`` (key, node) whose group has members of several components, its size and smallest node."""
    of_key = rooted(large.select("key", "node"), maps).groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("leader"), F.min("root").alias("low"), F.max("root").alias("high"))
    return large.select("key", "node").join(of_key.where("low <> high").select("key", "members", "leader"), "key")


def signed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (of any type), digest of the text, text."""
    text = quoted(text_col).cast("string")
    return bounded_batches(docs).select(quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))


def nodes_of(signed: DataFrame) -> DataFrame:
    """node, rep (the smallest id that has the set), digest (of one of its rows of that id), n, signature."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest"))
    found = signed.where("n_shingles > 0").groupBy("node").agg(first.alias("first"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    return durable(found.select("node", "first.doc_id", "first.digest", "n", "signature").withColumnRenamed("doc_id", "rep"))


def jaccard_components(docs: DataFrame, threshold: Fraction = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Defined results: null and word-less texts have no shingles and link with nothing; texts are read
    whole; repeated rows (equal ids or texts) are documents of their own, which link as their texts
    do; rows without an id link as well, but a null id is never a component's id unless no row of it has
    one; ids may be of any type that has an order; an empty table gives an empty result; extra columns are ignored.
    """
    return linked_rows(docs, threshold, k, id_col, text_col).drop("digest")


def linked_rows(docs: DataFrame, threshold: Fraction = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``jaccard_components``, with the digest of each row's text."""
    t = Fraction(threshold)
    rows = signed_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    signed = durable(rows.mapInArrow(_sign(k), f"doc_id {id_type}, digest long, n_shingles long, node long, signature array<long>"))
    nodes = nodes_of(signed)

    shared = _common(rows, t, k)
    keys = rows.select("text").mapInArrow(_keys(t, k, shared), "key long, node long, role long")
    met = durable(keys.groupBy("key").agg(F.count(F.lit(1)).alias("shown")).where("shown > 1"))
    members = keys.join(met, "key")
    pairs = _pairs_in_groups(members.where(F.col("shown") <= DIRECT_GROUP), t).select("a", "b", F.lit(None).cast("long").alias("key"))
    node = F.when(F.col("role") > 0, F.col("node"))  # always; with the same columns, both halves read the same shuffled keys
    hot = members.where(F.col("shown") > DIRECT_GROUP).select(node.alias("a"), node.alias("b"), "key")
    found = durable(pairs.unionByName(hot).distinct())  # a pair; or a member of a large group, twice, and the group's key

    large = found.where("a = b").select("key", F.col("a").alias("node"))
    large = large.join(large.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("leader")), "key")
    led = large.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = durable(_not_too_different(found.where("a <> b").select("a", "b").unionByName(led).distinct(), nodes, t))
    maps = connected_further([], durable(pairs_that_link(pairs, pair_sets(pairs, nodes, rows, k, shared), t)))
    if not large.isEmpty():
        maps = settled(large, maps, rows, nodes, t, k, shared)
    return with_component(signed, nodes, maps)


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents whose own id is their component's; of rows equal in id and text one. found: doc_id, digest, component_id."""
    first = durable(found.where("doc_id <=> component_id").groupBy(F.col("doc_id").alias("__first"), F.col("digest").alias("__digest")).agg(F.count(F.lit(1)).alias("__n")))
    digest = F.xxhash64(quoted(text_col).cast("string"))
    kept = docs.join(first, quoted(id_col).eqNullSafe(F.col("__first")) & (digest == F.col("__digest")), "left_semi")
    if first.where("__n > 1").isEmpty():
        return kept
    rec = kept.select(F.struct(*[quoted(c) for c in docs.columns]).alias("rec"), quoted(id_col).alias("id"), digest.alias("digest"))
    once = rec.withColumn("n", F.row_number().over(Window.partitionBy("id", "digest").orderBy("digest"))).where("n = 1")
    return once.select(*[F.col("rec").getField(c).alias(c) for c in docs.columns])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, in their own columns, with one of each component: a row with the smallest id.

    Of rows that are equal in id and text one stays; a row without an id stays only where its component has no row with one.
    """
    return first_of_each(docs, linked_rows(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


ORACLE = """
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
    sizes AS (SELECT d.doc_id, count(s.s) AS n FROM docs d LEFT JOIN sets s USING (doc_id) GROUP BY d.doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)),
    reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
    SELECT r.doc_id, s.n AS n_shingles, min(r.other) AS component_id FROM reach r JOIN sizes s USING (doc_id) GROUP BY r.doc_id, s.n"""
