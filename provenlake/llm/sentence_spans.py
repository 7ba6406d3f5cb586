"""Substring dedup by sliding sentence spans.

Every run of ``RUN`` consecutive sentences is hashed, and the runs are joined over the whole corpus. The first
occurrence of a run, by (doc_id, text digest) and then by place, stays; the sentences that any other occurrence covers
are removed, in other documents and in the same one. Occurrences that overlap the first one in its own document are no
repeats of it.

With ``passage_words`` no passage of that many words stays whole in two documents either, however its sentences
fall. A window of so many words that holds a whole run with a word around it needs nothing more.
Of any other window the ``ANCHOR_WORDS`` words with the least hash (its anchor) are hashed like a run, so
equal windows have equal anchors; the words of all anchors but the first go.

A sentence ends with a word that ends in . ! or ?, and at a line's end; sentences are compared by their
words. The hash has 128 bits, so that runs by the trillion don't collide; only hashes, ids and places are
shuffled before the removals are known, and then only the texts of documents that may lose something.

Defined results: null text stays null and empty text empty, with no sentences; texts are read whole; ids may be of any
type that has an order; rows with equal doc_id and equal text are one document (they get
equal results); rows with one doc_id and different texts are documents of their own, and so are texts
without an id; nulls come first in the order; texts without a removed sentence stay byte for byte as they
are; an empty table gives an empty result; further columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bounded_batches, durable, quoted, with_maybe
from ._shingles import RunHashes, chunks, span_hashes, word_spans

#: Sentences in a run: fewer are common lines of clean documents.
RUN = 5
ANCHOR_WORDS = 36
#: Passages of over 50 words go.
PASSAGE_WORDS = 51
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?"]] = True


class Sentences:
    """Words and sentences of several texts at once, as numpy arrays of places."""

    def __init__(self, texts: list[bytes | None]):
        self.data, self.start, self.end, self.begins = word_spans(texts)
        self.text = np.searchsorted(self.begins, self.start, side="right") - 1
        lines = np.concatenate(([0], np.cumsum(self.data == 10)))
        n = len(self.start)
        ends = np.ones(n, dtype=bool)
        ends[:-1] = _END[self.data[self.end[:-1] - 1]] | (lines[self.start[1:]] > lines[self.end[:-1]])
        #: The first word of each sentence, and the number of all words; the sentence of each word.
        self.first = np.concatenate(([0], np.flatnonzero(ends) + 1)) if n else np.zeros(1, dtype=np.int64)
        self.of = np.cumsum(np.concatenate(([0], ends[:-1]))) if n else np.zeros(0, dtype=np.int64)
        #: The text of each sentence; how many sentences each text has, and how many come before it.
        self.owner = self.text[self.first[:-1]]
        self.count = np.bincount(self.owner, minlength=len(texts))
        self.before = np.cumsum(self.count) - self.count
        #: The number of the first word of each text, and of all words.
        self.words_before = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first sentence of each run, and the one after its last: all runs within a text."""
        a = np.arange(max(len(self.owner) - size + 1, 0))
        a = a[self.owner[a] == self.owner[a + size - 1]]
        return a, a + size

    def anchors(self, hashes: RunHashes, size: int, passage_words: int) -> np.ndarray:
        """The first word of each anchor."""
        at = np.arange(max(len(self.start) - passage_words + 1, 0))
        at = at[self.text[at] == self.text[at + passage_words - 1]]
        # Whole sentences inside, with a word of the window on either side, so that nothing outside tells where they end.
        a, b = self.of[at] + 1, self.of[at + passage_words - 1]
        at = at[b - a < size]
        if not len(at):
            return at
        places = np.arange(len(self.start) - ANCHOR_WORDS + 1)
        windows = np.lib.stride_tricks.sliding_window_view(hashes.of(places, places + ANCHOR_WORDS)[0], passage_words - ANCHOR_WORDS + 1)
        return np.unique(at + np.concatenate([windows[at[i : i + 16384]].argmin(axis=1) for i in range(0, len(at), 16384)]))


#: Tells an anchor's hash from that of a run of the same words.
_ANCHOR = np.uint64(0x5DEECE66D1A2B3C4)


def _emit(size: int, passage_words: int | None):
    """doc, text -> one row a run and one an anchor: its first sentence, or -1 less its first word; and two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0)
            for at, texts in chunks(batch.column(1).cast(pa.binary())):
                s = Sentences(texts)
                hashes = RunHashes(span_hashes(s.data, s.start, s.end))
                a, b = s.runs(size)
                which, place, h = s.owner[a], a - s.before[s.owner[a]], hashes.of(s.first[a], s.first[b])
                if passage_words is not None:
                    w = s.anchors(hashes, size, passage_words)
                    which, place = np.concatenate((which, s.text[w])), np.concatenate((place, s.words_before[s.text[w]] - w - 1))
                    h = np.concatenate((h, hashes.of(w, w + ANCHOR_WORDS) ^ _ANCHOR), axis=1)
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(which + at)), pa.array(place.astype(np.int32)), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64))], names=["doc", "place", "h1", "h2"])

    return run


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds ``__doc``, which tells documents apart and orders them: the id, or id and text digest where ids are null or have two texts."""
    id, digest = quoted(id_col), F.xxhash64(quoted(text_col).cast("string"))
    several = docs.groupBy(id.alias("id")).agg(F.min(digest).alias("low"), F.max(digest).alias("high")).where("id IS NULL OR low <> high")
    return docs.withColumn("__doc", id if several.isEmpty() else F.struct(id.alias("id"), digest.alias("digest")))


def _covered(named: DataFrame, text_col: str, size: int, passage_words: int | None) -> DataFrame:
    rows = bounded_batches(named).select(F.col("__doc").alias("doc"), quoted(text_col).cast("string").alias("text"))
    schema = rows.select("doc", F.lit(0).alias("place"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2")).schema
    found = rows.mapInArrow(_emit(size, passage_words), schema)
    at = F.struct("doc", F.abs("place").alias("at"))
    firsts = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    # Written before the join, so that Spark can split the partition of a run that very many documents share.
    firsts = durable(firsts.where("first <> last").select("h1", "h2", "first"))
    apart = F.abs("place") - F.col("first.at") >= F.when(F.col("place") < 0, ANCHOR_WORDS).otherwise(size)
    later = found.join(firsts, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first.doc")) | apart)
    return later.groupBy("doc").agg(F.sort_array(F.collect_set("place")).alias("places"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = RUN, passage_words: int | None = None) -> DataFrame:
    """doc, places: the runs of each document (by their first sentence) and its anchors (-1 less their first word) that stand earlier, too."""
    return _covered(_named(docs, id_col, text_col), text_col, size, passage_words)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(data: bytes, places: list[int], size: int = RUN) -> tuple[bytes, int, int]:
    """The text without the covered stretches and anchors, the number of its sentences, and of those that lost a word.

    White space after what is removed goes with it.
    """
    s = Sentences([data])
    stretches = merged([(p, p + size) for p in places if p >= 0])
    words = [(int(s.first[a]), int(s.first[b])) for a, b in stretches]
    words = merged(words + [(-p - 1, -p - 1 + ANCHOR_WORDS) for p in places if p < 0])
    out, done, hit = [], 0, np.zeros(len(s.start), dtype=bool)
    for a, b in words:
        out.append(data[done : s.start[a]])
        done = int(s.start[b]) if b < len(s.start) else len(data)
        hit[a:b] = True
    return b"".join([*out, data[done:]]), len(s.owner), len(np.unique(s.of[hit]))


def _cutter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("text").cast(pa.binary())
            texts, counts, gone = [], [], []
            places = batch.column("places")
            for at, some in chunks(old):
                counts += Sentences(some).count.tolist()
                for i, data in enumerate(some, at):
                    new, n = data, 0
                    if places[i].is_valid:
                        new, _, n = cut(data or b"", places[i].as_py(), size)
                    texts.append(new)
                    gone.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("rec"), pa.array(texts, type=pa.binary()).cast(pa.string()), pa.array(counts, type=pa.int64()), pa.array(gone, type=pa.int64())], names=["rec", "text", "n_sentences", "n_removed"])

    return run


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = RUN, keep: list[str] | None = None, passage_words: int | None = None) -> DataFrame:
    """rec (a struct of the kept columns but the text), text (without repeated spans), n_sentences, n_removed."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col]
    rec = F.struct(*[quoted(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    slim = docs.select(rec.alias("rec"), quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    named = _named(slim, "id", "text")
    spans = durable(_covered(named, "text", size, passage_words))
    rows = with_maybe(named.select("rec", "text", F.col("__doc").alias("__id")), F.col("__id"), spans.select("doc"))
    may = rows.where("__maybe").join(spans, F.col("__id").eqNullSafe(F.col("doc")), "left").select("rec", "text", "places")
    met = may.unionByName(rows.where("NOT __maybe").select("rec", "text", F.lit(None).cast("array<int>").alias("places")))
    schema = met.select("rec", "text", F.lit(0).cast("long").alias("n_sentences"), F.lit(0).cast("long").alias("n_removed")).schema
    return met.mapInArrow(_cutter(size), schema)
