"""Hard-negative mining by threshold joins over an inverted index with norm bounds (after L2AP, Anastasiu and Karypis 2014).

Vectors become integers, floor(256 x). A stated query set, the anchors, goes against all rows. All searches are threshold
joins: for each anchor all rows whose inner product reaches the anchor's threshold.

1. A bounded sample (``SAMPLE_ROWS`` rows a label) gives each anchor a first threshold: its fifth best row of the own label in
   the sample. The join at that threshold finds the positives, which can't be worse.
2. A positive of score p opens the window [ceil(p / 2), floor(95 p / 100)]. The threshold of a window begins at ``STEPS[0]`` of its
   upper end; a window is settled once its join has given three rows of other labels, or its threshold is its lower end. The thresholds
   of all others are lowered (``STEPS``), and only their anchors are joined again.

The join of a batch of rows with a block of anchors. Dimensions are ordered by the batch's energy. A row's index
holds its dimensions only up to where the norm of the rest, times the largest norm that any anchor has left there, is below the least
threshold: rows that reach a threshold must reach part of it in the indexed dimensions. Partial scores are accumulated over
the index, stretch by stretch; pairs whose partial score plus the product of the remaining norms is below the anchor's threshold are
pruned, and only what is left is completed by the dimensions that the index omits. The scores are exact integers in doubles.

Anchors go to the tasks in blocks of ``BLOCK_BYTES`` at most, broadcast one after the other and never all at once; rows are not
shuffled. Each batch of rows hands on no more than the best five (three) rows of an anchor (a window).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._base import bounded_batches, durable, quoted

ANCHOR_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
SAMPLE_ROWS = 2000
STEPS = (0.9, 0.75, 0.0)
BLOCK_BYTES = 16 << 20
SUB_BLOCK = 256
STRETCHES = 8
#: Components beyond it would leave the integers that a double holds exactly.
LARGEST = 1 << 20


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v (array of int), without repeated rows."""
    v = quoted(vector_col)
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * 256))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / 256))
    rows = vectors.where(quoted(id_col).isNotNull() & quoted(label_col).isNotNull() & v.isNotNull() & fine)
    id, label = quoted(id_col).cast("long"), quoted(label_col).cast("int")
    return rows.select(id.alias("vec_id"), F.when(id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole.cast("array<int>").alias("v")).distinct()


def _stretches(n: int) -> list[tuple[int, int]]:
    edges = sorted({round(n * i / STRETCHES) for i in range(STRETCHES + 1)})
    return list(zip(edges[:-1], edges[1:], strict=True))


def threshold_join(anchors: np.ndarray, least: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of all pairs whose inner product is at least the anchor's ``least``, for some anchors at a time."""
    if not len(anchors) or not len(rows):
        return
    n = rows.shape[1]
    order = np.argsort(-(rows * rows).sum(axis=0), kind="stable")
    a, y = anchors[:, order].astype(np.float64), rows[:, order].astype(np.float64)
    stretches = _stretches(n)
    rest = lambda x: np.stack([np.sqrt((x[:, lo:] ** 2).sum(axis=1)) for lo, _ in stretches] + [np.zeros(len(x))])
    a_rest, y_rest = rest(a), rest(y)  # norms of what follows before each stretch, and of nothing at the end
    far = y_rest * a_rest.max(axis=1)[:, None] < least.min() - 0.5
    held = np.where(far.any(axis=0), far.argmax(axis=0), len(stretches))  # stretches of each row that are indexed
    by_length = np.argsort(-held, kind="stable")
    y, y_rest, held = y[by_length], y_rest[:, by_length], held[by_length]
    for at in range(0, len(a), SUB_BLOCK):
        own, own_rest, bound = a[at : at + SUB_BLOCK], a_rest[:, at : at + SUB_BLOCK], least[at : at + SUB_BLOCK].astype(np.float64) - 0.5
        total = np.zeros((len(own), len(y)))
        dense = (3 * len(stretches) + 3) // 4
        for s, (lo, hi) in enumerate(stretches[:dense]):
            n_held = int(np.searchsorted(-held, -s, side="left"))  # rows that have this stretch in their index
            total[:, :n_held] += own[:, lo:hi] @ y[:n_held, lo:hi].T
        done = np.minimum(held, dense)
        left = own_rest[done].T * y_rest[done, np.arange(len(y))]
        may = total + left >= bound[:, None]
        if may.sum() * 8 > may.size:  # little was pruned: the rest of all pairs, stretch by stretch as before
            for s, (lo, hi) in enumerate(stretches):
                rest_of = int(np.searchsorted(-done, -s, side="left"))  # rows from here on lack this stretch
                total[:, rest_of:] += own[:, lo:hi] @ y[rest_of:, lo:hi].T
            may, done = total >= bound[:, None], np.full(len(y), len(stretches))
        i, j = np.nonzero(may)
        score = total[i, j]
        for s, (lo, hi) in enumerate(stretches):
            if not len(i):
                break
            more = s >= done[j]
            if more.any():
                score[more] += np.einsum("ij,ij->i", own[i[more], lo:hi], y[j[more], lo:hi])
                reaches = ~more | (score + own_rest[s + 1, i] * y_rest[s + 1, j] >= bound[i])
                i, j, score = i[reaches], j[reaches], score[reaches]
        yield i + at, by_length[j], score.astype(np.int64)


def _best(key: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each key: higher scores first, then smaller ids."""
    order = np.lexsort((vec_id, -score, key))
    sorted_key = key[order]
    first = np.searchsorted(sorted_key, sorted_key, side="left")
    return order[np.arange(len(order)) - first < k]


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """vec_id, label and matrix of the rows of each length of vector."""
    ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    flat, ends = vectors.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(vectors.offsets.to_numpy()))))
    lengths = np.diff(ends)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield ids[at], labels[at], flat[ends[at][:, None] + np.arange(n)].astype(np.int64)


def _positives(block):
    """vec_id, label, v -> anchor, vec_id, score: the best rows of each anchor's own label in each batch. block: anchor, id, label, least, matrix by length of vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, matrix in _arrays(batch):
                for length, anchor, anchor_id, anchor_label, least, vectors in block.value:
                    if length != matrix.shape[1]:
                        continue
                    for label in np.unique(labels):
                        rows, own = np.flatnonzero(labels == label), np.flatnonzero(anchor_label == label)
                        for i, j, score in threshold_join(vectors[own], least[own], matrix[rows]):
                            i, j = own[i], rows[j]
                            other = ids[j] != anchor_id[i]
                            i, j, score = i[other], j[other], score[other]
                            best = _best(i, score, ids[j], POSITIVES)
                            yield pa.RecordBatch.from_arrays([pa.array(anchor[i[best]]), pa.array(ids[j[best]]), pa.array(score[best])], names=["anchor", "vec_id", "score"])

    return run


def _negatives(block):
    """vec_id, label, v -> anchor, positive (its place), vec_id, label, score: the best rows of each window in each batch.

    block: anchor, id, label, least (of its windows), vectors, and of each window: place of the anchor, place of the positive, low, high.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, matrix in _arrays(batch):
                for length, anchor, _, anchor_label, least, vectors, owner, place, low, high in block.value:
                    if length != matrix.shape[1]:
                        continue
                    first, n_windows = np.searchsorted(owner, np.arange(len(anchor))), np.bincount(owner, minlength=len(anchor))
                    for i, j, score in threshold_join(vectors, least, matrix):
                        other = labels[j] != anchor_label[i]
                        i, j, score = i[other], j[other], score[other]
                        for w in range(int(n_windows.max(initial=0))):
                            window = np.minimum(first[i] + w, len(owner) - 1)
                            fits = (w < n_windows[i]) & (score >= low[window]) & (score <= high[window])
                            at = np.flatnonzero(fits)
                            best = at[_best(window[at], score[at], ids[j[at]], NEGATIVES)]
                            yield pa.RecordBatch.from_arrays([pa.array(anchor[i[best]]), pa.array(place[window[best]]), pa.array(ids[j[best]]), pa.array(labels[j[best]].astype(np.int32)), pa.array(score[best])], names=["anchor", "place", "vec_id", "label", "score"])

    return run


def _blocks(anchors: DataFrame, block_bytes: int) -> Iterator[pa.Table]:
    """The anchors, some at a time, of at most ``block_bytes`` each as 64-bit numbers. anchors: written rows with ``v``."""
    total = anchors.agg(F.sum(F.size("v") * 8 + 64).alias("n")).first()["n"] or 0
    n = max(-(-total * 5 // (4 * block_bytes)), 1)
    for b in range(n):
        got = anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(n)) == b).toArrow()
        if got.num_rows:
            yield got.sort_by("anchor").combine_chunks()


def _by_length(block: pa.Table) -> Iterator[tuple]:
    """length, places of the rows, and their matrix."""
    vectors = block.column("v").combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, ends = vectors.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths)))
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        yield n, at, flat[ends[at][:, None] + np.arange(n)].astype(np.int32)


def _joined(rows: DataFrame, anchors: DataFrame, block_bytes: int, make, task, schema: str) -> DataFrame:
    """The task's rows for all blocks of anchors; one scan of ``rows`` for each."""
    sc = rows.sparkSession.sparkContext
    legs = [rows.mapInArrow(task(sc.broadcast(make(block))), schema) for block in _blocks(anchors, block_bytes)]
    return reduce(DataFrame.unionAll, legs) if legs else rows.sparkSession.createDataFrame([], schema)


def _top(found: DataFrame, keys: list[str], k: int, *ties: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", *ties))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _first_thresholds(anchors: DataFrame, rows: DataFrame, sample_rows: int, block_bytes: int) -> DataFrame:
    """The anchors with ``least``: the score of the fifth best row of their label in a sample, or the least of all numbers where it has fewer."""
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.xxhash64("vec_id").cast("double") / 2.0**64 + 0.5 <= sample_rows / F.col("n")
    sample = rows.join(sizes, "label").where(share).select("vec_id", "label", "v")

    def make(block: pa.Table) -> list[tuple]:
        col = lambda c: block.column(c).to_numpy()
        return [(n, col("anchor")[at], col("vec_id")[at], col("label")[at], np.full(len(at), np.iinfo(np.int64).min // 2), m) for n, at, m in _by_length(block)]

    best = _top(_joined(sample, anchors, block_bytes, make, _positives, "anchor long, vec_id long, score long"), ["anchor"], POSITIVES)
    known = best.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).where(F.col("n") == POSITIVES)
    return anchors.join(known.select("anchor", "low"), "anchor", "left").select(*anchors.columns, F.coalesce("low", F.lit(np.iinfo(np.int64).min // 2)).alias("least"))


def mine(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample_rows: int = SAMPLE_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, negative_label.

    Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do those
    with a component of 4096 or more, whose products a double can't hold; vectors of unequal length don't meet; an empty
    vector has a score of 0 with any other empty one; repeated rows (equal in id, label and vector) count once, and of rows
    that share only the id each is a row, but none is another one's positive; equal scores come by the smaller id; an anchor without positives, and
    a positive with an empty window, give no row; an empty table gives an empty result; extra columns are ignored.
    """
    rows = durable(bounded_batches(usable(vectors, id_col, vector_col, label_col)))
    # an anchor's number: the row itself, since rows may share an id
    anchors = durable(rows.where(F.col("vec_id") % ANCHOR_EVERY == 0).select(F.xxhash64("vec_id", "label", "v").alias("anchor"), "vec_id", "label", "v"))
    anchors = durable(_first_thresholds(anchors, rows, sample_rows, block_bytes))

    def of_positives(block: pa.Table) -> list[tuple]:
        col = lambda c: block.column(c).to_numpy()
        return [(n, col("anchor")[at], col("vec_id")[at], col("label")[at], col("least")[at], m) for n, at, m in _by_length(block)]

    found = _joined(rows, anchors, block_bytes, of_positives, _positives, "anchor long, vec_id long, score long")
    positives = durable(_top(found, ["anchor"], POSITIVES).select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    p = F.col("positive_score")
    low, high = F.expr("cast(ceil(positive_score / 2) as long)"), F.floor(p * 95 / 100)
    windows = positives.select("anchor", "place", low.alias("low"), F.when(p >= 0, F.expr("(positive_score * 95) div 100")).otherwise(high).alias("high")).where("low <= high")

    def of_windows(block: pa.Table) -> list[tuple]:
        col, out = lambda c: block.column(c).to_numpy(), []
        for n, at, m in _by_length(block):
            lists = [block.column("windows").combine_chunks().take(pa.array(at))]
            counts, each = np.diff(lists[0].offsets.to_numpy()), lists[0].flatten()
            out.append((n, col("anchor")[at], col("vec_id")[at], col("label")[at], col("least")[at], m, np.repeat(np.arange(len(at)), counts), *(each.field(c).to_numpy() for c in ("place", "low", "high"))))
        return out

    open_windows, settled = windows, []
    for step in STEPS:
        # at least the lower end: the join is complete from there on
        now = durable(open_windows.withColumn("from", F.greatest("low", F.floor(F.col("high") * step))))
        if now.isEmpty():
            break
        asked = anchors.drop("least").join(now.groupBy("anchor").agg(F.min("from").alias("least"), F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("windows")), "anchor")
        hits = _joined(rows, durable(asked), block_bytes, of_windows, _negatives, "anchor long, place int, vec_id long, label int, score long")
        hits = _top(hits, ["anchor", "place"], NEGATIVES, "label").join(now.select("anchor", "place", "low", "from"), ["anchor", "place"])
        least = F.min("from").over(Window.partitionBy("anchor"))
        counted = durable(hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor", "place"))))
        done = durable(now.withColumn("least", least).join(counted.groupBy("anchor", "place").agg(F.count(F.lit(1)).alias("n")), ["anchor", "place"], "left").withColumn("full", (F.coalesce("n", F.lit(0)) == NEGATIVES) | (F.col("least") <= F.col("low"))))
        settled.append(counted.join(done.where("full").select("anchor", "place"), ["anchor", "place"], "left_semi").select("anchor", "place", "rank", "vec_id", "label", "score"))
        open_windows = done.where("not full").select("anchor", "place", "low", "high")
    empty = rows.sparkSession.createDataFrame([], "anchor long, place int, rank int, vec_id long, label int, score long")
    hits = reduce(DataFrame.unionAll, settled, empty)
    named = hits.join(positives, ["anchor", "place"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("label").alias("negative_label"))


ORACLE = """
    WITH usable AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= 4096)) = 0),
    anchors AS (SELECT * FROM usable WHERE vec_id % 50 = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, r.label AS of, a.label, CASE WHEN len(a.v) = 0 THEN 0 ELSE list_dot_product(a.v, r.v)::BIGINT END AS score
        FROM anchors a JOIN usable r ON len(a.v) = len(r.v) AND a.vec_id <> r.vec_id),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE of = label
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    fits AS (
        SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, s.of AS negative_label,
            row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.of <> s.label
            AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score, negative_label FROM fits WHERE rank <= 3"""
