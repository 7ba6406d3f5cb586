"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text is a vector of hashed byte trigrams and a few marks of its build (repetition, capitals, word
length), each as the level that the sample's quantiles put it in. A truncated SVD of a bounded sample of labelled texts gives the latent axes; the sample's
own vectors are broadcast (at most 2 x ``SAMPLE_PER_LABEL`` x ``AXES`` floats). Every document is
projected and compared with all of them, block by block, by exact cosine; its nearest neighbours vote
with their labels, each weighted by its similarity and by how rare its label is in the sample against
all labelled rows.

Defined results: null text counts as empty text, which has marks of its own and so gets a score too;
texts are read whole; of labelled vectors with the same cosine the ones that come first in the sample (label 0
first, then in the order of the id's hash) are nearer; rows with several different labels for one id are not learned from, equal texts
in the sample count once; with no labelled row every score is 0.5; repeated rows get equal results
each; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bounded_batches, hash_sample, held_out, quoted

SAMPLE_PER_LABEL = 1500
OVERSAMPLE = 2
TERMS = 1024
AXES = 48
NEIGHBOURS = 25
BLOCK = 512
#: What tells of a text's build; each has one term for each of its levels.
MARKS = ("words", "repeated_neighbours", "repeated_lines", "distinct_words", "capitals", "marks", "word_size")
#: The levels are bounded by these quantiles of the labelled sample.
QUANTILES = (0.1, 0.3, 0.5, 0.7, 0.9)
LEVELS = len(QUANTILES) + 1
WIDTH = TERMS + len(MARKS)
MARK_WEIGHT = 0.35
STRETCH = 50
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_ALPHA = np.array([65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])


def text_terms(data: bytes) -> np.ndarray:
    """Counts of the hashed trigrams, then the values of the marks."""
    out = np.zeros(WIDTH, dtype=np.float32)
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) >= 3:
        wide = b.astype(np.uint32)
        code = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(22)
        out[:TERMS] = np.bincount(code, minlength=TERMS)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, letters, spaces = len(words), int(_ALPHA[b].sum()), int(_SPACE[b].sum())
    out[TERMS:] = (
        n,
        sum(map(operator.eq, words, words[1:])) / max(n, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        # Distinct words of each stretch, so that a long text doesn't count as a poor one.
        sum(len(set(words[i : i + STRETCH])) for i in range(0, n, STRETCH)) / max(n, 1),
        int(_UPPER[b].sum()) / max(letters, 1),
        (len(b) - letters - spaces) / max(len(b) - spaces, 1),
        (len(b) - spaces) / max(n, 1),
    )
    return out


def _top_axes(gram: np.ndarray, rounds: int = 8) -> np.ndarray:
    """The AXES leading right singular vectors, by subspace iteration on the Gram matrix."""
    basis = np.random.default_rng(11).normal(size=(len(gram), AXES + 16))
    for _ in range(rounds):
        basis, _ = np.linalg.qr(gram @ basis)
    size, turn = np.linalg.eigh(basis.T @ gram @ basis)
    return np.ascontiguousarray(basis @ turn[:, np.argsort(size)[::-1][:AXES]]).astype(np.float32)


class LatentVoter:
    """The latent axes and the labelled vectors."""

    def __init__(self, terms: np.ndarray, labels: np.ndarray, share: dict[int, float], neighbours: int = NEIGHBOURS):
        self.labels = labels.astype(np.float32)
        self.neighbours = min(neighbours, len(labels))
        at_all = (terms[:, :TERMS] > 0).sum(axis=0)
        self.idf = np.log((1 + len(terms)) / (1 + at_all)).astype(np.float32) + 0.1
        self.bounds = np.quantile(terms[:, TERMS:], QUANTILES, axis=0)
        x = self.weighted(terms)
        self.axes = _top_axes(x.T @ x)
        self.vectors = self.unit(x @ self.axes)
        of = {v: (self.labels == v).mean() for v in share}
        self.weight = np.array([share[int(v)] / of[int(v)] for v in labels], dtype=np.float32)
        self.prior = float((self.labels * self.weight).sum() / self.weight.sum())

    def weighted(self, terms: np.ndarray) -> np.ndarray:
        tf = np.log1p(terms[:, :TERMS]) * self.idf
        level = (terms[:, None, TERMS:] >= self.bounds[None]).sum(axis=1)
        marks = np.zeros((len(terms), len(MARKS) * LEVELS), dtype=np.float32)
        np.put_along_axis(marks, level + LEVELS * np.arange(len(MARKS)), MARK_WEIGHT, axis=1)
        return np.concatenate((self.unit(tf), marks), axis=1)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Share of the weighted votes for label 1 among the nearest vectors; the cosines of a block with all labelled vectors are exact."""
        cosine = self.unit(self.weighted(terms) @ self.axes) @ self.vectors.T
        near = np.argpartition(-cosine, self.neighbours - 1, axis=1)[:, : self.neighbours]
        least = np.take_along_axis(cosine, near, axis=1).min(axis=1)
        for i in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > self.neighbours):  # equal ones on the edge
            near[i] = np.argsort(-cosine[i], kind="stable")[: self.neighbours]
        w = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 4 * self.weight[near]
        total = w.sum(axis=1)
        return np.where(total > 0, (w * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), self.prior).clip(0, 1)


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [zlib.compress(text_terms(t.as_py() or b"").tobytes(), 1) for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("n"), batch.column("label"), pa.array(terms, type=pa.binary())], names=["n", "label", "terms"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_label: int = SAMPLE_PER_LABEL) -> LatentVoter | None:
    """A voter learned from labelled rows that aren't held out; None if there are none.

    The sample is drawn by a hash of the id, up to ``per_label`` different texts of each label (0 and
    1); its ids come from the labels alone, so that only the sample's texts are gathered.
    """
    known = labels.select(quoted(id_col).alias("doc_id"), quoted(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    top, shares = hash_sample(known, "label", "doc_id", per_label * OVERSAMPLE, 2 * per_label * OVERSAMPLE)
    texts = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text")).join(F.broadcast(top), "doc_id")  # at most 2 * per_label * OVERSAMPLE ids
    texts = texts.groupBy("n", "label", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one of each, on however many rows it stands
    got = texts.select("n", "label", "text").mapInArrow(_terms_of, "n int, label int, terms binary").toArrow()
    rows = sorted(zip(got.column("label").to_pylist(), got.column("n").to_pylist(), got.column("terms").to_pylist(), strict=True))
    kept: dict[int, dict[bytes, None]] = {}
    for label, _, terms in rows:
        if len(mine := kept.setdefault(label, {})) < per_label:
            mine.setdefault(terms)
    if not kept:
        return None
    y = np.array([label for label, mine in kept.items() for _ in mine])
    x = np.array([np.frombuffer(zlib.decompress(t), dtype=np.float32) for mine in kept.values() for t in mine])
    total = sum(shares[v] for v in kept)
    return LatentVoter(x, y, {v: shares[v] / total for v in kept})


def _apply(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = shared.value
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            scores = np.full(len(texts), 0.5)
            for a in range(0, len(texts) if voter is not None else 0, BLOCK):
                block = texts.slice(a, BLOCK)
                scores[a : a + len(block)] = voter.score(np.stack([text_terms(t.as_py() or b"") for t in block]))
            yield pa.RecordBatch.from_arrays([batch.column("rec"), pa.array(scores)], names=["rec", "score"])

    return run


def score_quality(docs: DataFrame, voter: LatentVoter | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """rec (a struct of the kept columns), score (0 to 1; higher: label 1 likelier)."""
    keep = docs.columns if keep is None else keep
    rows = bounded_batches(docs).select(F.struct(*[quoted(c) for c in keep]).alias("rec"), quoted(text_col).cast("string").alias("text"))
    schema = rows.select("rec", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(voter)), schema)
