"""Aligning two tokenizers' tokens of the same text, by windows between whitespace-marked tokens.

Every text is tokenised as a whole by both tokenizers: A is a byte-level BPE (a ``tokenizers`` JSON file, read for ``tiktoken``), B a
sentence-piece BPE. The bytes of the tokens tell where they end. An end that both share, and after which both next tokens begin with the
space mark, is an anchor: the documents are split there into windows of token ids. What a window's alignment is follows from its ids
alone, so alignments are memoised by the pair of id tuples, and most windows of a corpus are looked up.

An alignment holds groups (cut at every shared end) and links (pairs of tokens whose bytes overlap). How many documents
hold a pair of ids linked is counted over the whole corpus in Spark; those counts are as many as there are pairs of ids, so they go back to the
documents in parts of a bounded number of pairs, dealt by A's id, and each part is broadcast on its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialise import released_shuffles
from ._base import bounded_batches, durable, quoted, shared_folder
from ._shingles import chunks

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level tokenizer splits texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of the windows that a worker remembers; beyond that it begins anew.
MEMO_TOKENS = 1 << 21
#: Pairs of a part of the counts.
PART_PAIRS = 1 << 20
SPACE = b" "


@dataclass(frozen=True)
class Vocabularies:
    """The two tokenizers' files, as bytes: a few MB, sent to the workers."""

    byte_bpe: bytes
    pieces: bytes

    @classmethod
    def read(cls, folder: str = TOKENIZERS, byte_bpe: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> Vocabularies:
        return cls((Path(folder) / byte_bpe).read_bytes(), (Path(folder) / pieces).read_bytes())


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: visible Latin-1 characters for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def byte_ranks(file: bytes) -> dict[bytes, int]:
    """Bytes of each token and its id, special tokens left out, which in texts are plain.

    ``tiktoken`` merges by the rank of what a merge gives, so the file's merges must be in the order of the ids.
    """
    spec = json.loads(file)
    model, letters = spec["model"], _byte_letters()
    split = spec.get("pre_tokenizer") or {}
    if model["type"] != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("not a byte-level BPE with the usual pattern and without a normaliser")
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids):
        raise ValueError("merges aren't in the order of the ids")
    return {bytes(letters[c] for c in token): n for token, n in model["vocab"].items() if token not in special}


class Aligner:
    """Both tokenizers, and the memory of window alignments, of one worker."""

    def __init__(self, files: Vocabularies, memo_tokens: int = MEMO_TOKENS):
        import sentencepiece
        import tiktoken

        ranks = byte_ranks(files.byte_bpe)
        self.a = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, n in ranks.items():
            self.a_bytes[n] = token
        self.b_bytes = [self._piece(n) for n in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_marked = np.array([t.startswith(SPACE) for t in self.a_bytes])
        self.b_bits = (len(self.b_bytes) - 1).bit_length()
        # What is written for a token: its number and what follows it. A: "," "|"; B: "," ";" and a line's end after a window's last.
        self.written = [b"%d%s" % (n, after) for size, marks in ((len(self.a_bytes), (b",", b"|")), (len(self.b_bytes), (b",", b";", b"\n"))) for after in marks for n in range(size)]
        self.memo_tokens = memo_tokens
        self.forget()

    def _piece(self, n: int) -> bytes:
        piece = self.b.id_to_piece(n)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.memo: dict[tuple[bytes, bytes], int] = {}
        self.held = 0
        self.groups: list[bytes] = []
        self.n_groups, self.n_links = (np.zeros(0, dtype=np.int64) for _ in range(2))
        self.links = np.zeros(0, dtype=np.int64)  # linked pairs of all windows, packed, one window after the other

    def align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> None:
        """Remember the alignments of new windows: ids of A and of B, and how many each window has. Both sides of a window cover the same bytes.

        Between two neighbouring ends of either side lies one token of each, so the ends of both sides give the links.
        """
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        in_a, in_b = (np.zeros(int(a_end[-1]) + 1, dtype=bool) for _ in range(2))
        in_a[a_end], in_b[b_end] = True, True
        ends, both = np.flatnonzero(in_a | in_b), in_a & in_b
        upto_a, upto_b, groups = np.cumsum(in_a), np.cumsum(in_b), np.cumsum(both)
        of_a = upto_a[ends] - in_a[ends]  # the token that covers what lies before each end
        of_b = upto_b[ends] - in_b[ends]
        window = np.repeat(np.arange(len(n_a)), n_a)
        self.links = np.concatenate((self.links, a[of_a].astype(np.int64) << self.b_bits | b[of_b]))
        self.n_links = np.concatenate((self.n_links, np.bincount(window[of_a], minlength=len(n_a))))
        self.n_groups = np.concatenate((self.n_groups, np.bincount(window[both[a_end]], minlength=len(n_a))))
        place = np.argsort(np.concatenate((2 * (groups[a_end] - both[a_end]), 2 * (groups[b_end] - both[b_end]) + 1)), kind="stable")
        size_a, size_b = len(self.a_bytes), len(self.b_bytes)
        after_b = both[b_end].astype(np.int64)
        after_b[np.cumsum(n_b) - 1] = 2
        written = np.concatenate((a + size_a * both[a_end], 2 * size_a + b + size_b * after_b))[place]
        self.groups += b"".join(map(self.written.__getitem__, written.tolist())).split(b"\n")[:-1]
        self.held += len(a) + len(b)

    def tokens(self, texts: list[bytes | None]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of each text; both empty where a text is, or where their bytes aren't those of space and text."""
        some = [i for i, t in enumerate(texts) if t]
        plain = [texts[i].decode("utf-8", "replace") for i in some]
        a_ids, b_ids = [[] for _ in texts], [[] for _ in texts]
        for i, text, b in zip(some, plain, self.b.encode(plain, num_threads=1) if plain else [], strict=True):
            a, want = self.a.encode_ordinary(" " + text), SPACE + texts[i]
            if b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want:
                a_ids[i], b_ids[i] = a, b
        return a_ids, b_ids

    def documents(self, texts: list[bytes | None]) -> Iterator[tuple[int, int, list[int]]]:
        """n_a, n_b and the windows' numbers of each text."""
        if self.held > self.memo_tokens:
            self.forget()
        a_ids, b_ids = self.tokens(texts)
        n_a, n_b = np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids])
        a, b = (np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(total)) for ids, total in ((a_ids, n_a.sum()), (b_ids, n_b.sum())))
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])  # both run over the same bytes
        size = int(a_end[-1]) + 1 if len(a) else 1
        in_a, in_b, last = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        in_a[a_end], in_b[b_end] = True, True
        if len(a):
            last[a_end[np.cumsum(n_a)[n_a > 0] - 1]] = True
        marked = np.zeros(size, dtype=bool)  # where A's next token has the space mark; then B's has it, too
        if len(a):
            marked[a_end[:-1]] = self.a_marked[a[1:]]
        anchor = in_a & in_b & (marked | last)
        a_to, b_to = np.flatnonzero(anchor[a_end]) + 1, np.flatnonzero(anchor[b_end]) + 1
        per_text = np.diff(np.searchsorted(a_to, np.concatenate(([0], np.cumsum(n_a))), side="right"))
        a_raw, b_raw, memo = a.tobytes(), b.tobytes(), self.memo
        a_ends, b_ends = (4 * a_to).tolist(), (4 * b_to).tolist()
        keys = [(a_raw[i:j], b_raw[k:l]) for i, j, k, l in zip([0, *a_ends], a_ends, [0, *b_ends], b_ends, strict=False)]
        found, new = list(map(memo.get, keys)), []
        for i in [i for i, n in enumerate(found) if n is None]:
            n = memo.setdefault(keys[i], len(memo))
            if n == len(memo) - 1 and n >= len(self.groups) + len(new):
                new.append(i)
            found[i] = n
        if new:
            self.align(*_stretches(a, a_to, new), *_stretches(b, b_to, new))
        start = 0
        for x, y, count in zip(n_a.tolist(), n_b.tolist(), per_text.tolist(), strict=True):
            yield x, y, found[start : start + count]
            start += count


def _stretches(ids: np.ndarray, ends: np.ndarray, chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the chosen windows, one after the other, and the number of each one's."""
    starts, counts = np.concatenate(([0], ends[:-1]))[chosen], np.diff(ends, prepend=0)[chosen]
    return ids[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))], counts


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(files) -> Aligner:
    """This worker's aligner of a broadcast pair of vocabularies."""
    if files.id not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[files.id] = Aligner(files.value)
    return _ALIGNERS[files.id]


class _Files:
    """A broadcast that a worker can tell from another one."""

    def __init__(self, shared, id: str):
        self.shared, self.id = shared, id

    @property
    def value(self) -> Vocabularies:
        return self.shared.value


def _linked(aligner: Aligner, windows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times): the distinct linked pairs of each text, sorted by text; a pair is A's id x 2^32 + B's."""
    counts = np.array([len(w) for w in windows], dtype=np.int64)
    flat = np.fromiter(chain.from_iterable(windows), dtype=np.int64, count=int(counts.sum()))
    if not len(flat):
        return (np.zeros(0, dtype=np.int64),) * 3
    total = len(aligner.groups)
    each, times = np.unique(np.repeat(np.arange(len(windows)), counts) * total + flat, return_counts=True)
    text, window = each // total, each % total
    n = aligner.n_links[window]
    at = np.repeat((np.cumsum(aligner.n_links) - aligner.n_links)[window] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    bits, mask = aligner.b_bits, (1 << aligner.b_bits) - 1
    pair_bits = bits + (len(aligner.a_bytes) - 1).bit_length()
    spread, where = np.unique(np.repeat(text, n) << pair_bits | aligner.links[at], return_inverse=True)
    summed = np.bincount(where, weights=np.repeat(times, n)).astype(np.int64)  # far below 2^53
    pair = spread & ((1 << pair_bits) - 1)
    return spread >> pair_bits, (pair >> bits) << 32 | (pair & mask), summed


def _align(files: _Files, with_groups: bool):
    """..., text -> ..., n_a, n_b, n_groups, n_links, groups_sha256, pairs, times[, groups]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        for batch in batches:
            for at, texts in chunks(batch.column(batch.num_columns - 1).cast(pa.binary())):
                n_a, n_b, windows = (list(x) for x in zip(*aligner.documents(texts), strict=True))
                text, pair, times = _linked(aligner, windows)
                groups = [b";".join(map(aligner.groups.__getitem__, w)) for w in windows]
                digest = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                of_windows = np.concatenate(([0], np.cumsum(aligner.n_groups[np.fromiter(chain.from_iterable(windows), dtype=np.int64)])))
                n_groups = np.diff(of_windows[np.cumsum([0] + [len(w) for w in windows])])
                ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
                sums = np.concatenate(([0], np.cumsum(times)))
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (pair, times.astype(np.int32))]
                out = [batch.column(i).slice(at, len(texts)) for i in range(batch.num_columns - 1)]
                out += [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(np.diff(sums[ends])), pa.array(digest, pa.string()), *lists]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                if with_groups:
                    out, names = [*out, pa.array(groups, pa.binary()).cast(pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def align_documents(docs: DataFrame, files: Vocabularies | None = None, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (A's id x 2^32 + B's, distinct), times (how often each is linked), groups.

    Defined results: null and empty texts, and texts that a tokenizer doesn't give back byte by byte (such as those that hold
    U+2581), have no tokens: zeros, empty lists and an empty digest; texts are read whole; special tokens' strings inside texts are
    plain text; repeated rows are documents of their own; an empty table gives an empty result; extra columns are ignored.
    """
    files = files or Vocabularies.read()
    shared = _Files(docs.sparkSession.sparkContext.broadcast(files), hashlib.sha256(files.byte_bpe + files.pieces).hexdigest())
    rows = bounded_batches(docs).select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    id_type = rows.schema[0].dataType.simpleString()
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return rows.mapInArrow(_align(shared, with_groups), schema + (", groups string" if with_groups else ""))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: how many documents hold the pair linked."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _weigh(part):
    """row, pairs, times -> row, n_best, count_sum, over the pairs of one part of the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = part.value
        for batch in batches:
            lists = batch.column(1)
            pairs, times = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            hit = known[at] == pairs
            ends = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
            sums = [np.diff(np.concatenate(([0], np.cumsum(np.where(hit, x[at] * times, 0))))[ends]) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=["row", "n_best", "count_sum"])

    return run


def weigh_links(aligned: DataFrame, part_pairs: int = PART_PAIRS) -> DataFrame:
    """row, n_best (links whose pair is held linked by the most documents of all pairs of its A id), count_sum (of the links' counts).

    aligned: written rows with ``row``, ``pairs`` and ``times``. The counts are dealt into parts of about ``part_pairs`` pairs by A's id; each part is
    brought to the tasks in turn, so that no more of them is ever in one place, and the parts' sums are added per row.
    """
    counts = durable(pair_counts(aligned).withColumn("a", F.shiftright("pair", 32)))
    n_parts = -(-counts.count() // part_pairs)
    rows, sc = aligned.select("row", "pairs", "times"), aligned.sparkSession.sparkContext
    legs = []
    for p in range(n_parts):
        part = counts.where(F.pmod(F.xxhash64("a"), F.lit(n_parts)) == p).select("pair", "n").toArrow().sort_by("pair")
        if part.num_rows:
            pair, n = (part.column(c).to_numpy().astype(np.int64) for c in ("pair", "n"))
            first = np.flatnonzero(np.concatenate(([True], (pair[1:] >> 32) != (pair[:-1] >> 32))))
            most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.concatenate((first, [len(pair)]))))
            legs.append(rows.mapInArrow(_weigh(sc.broadcast((pair, n, (n == most).astype(np.int64)))), "row long, n_best long, count_sum long"))
    if not legs:
        return rows.select("row", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    return reduce(DataFrame.unionAll, legs).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def link_statistics(docs: DataFrame, files: Vocabularies | None = None, id_col: str = "doc_id", text_col: str = "text", part_pairs: int = PART_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; defined results as for ``align_documents``.

    Texts are tokenised once: what follows reads the pairs from a table in the shared folder.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "linked-pairs")
    with released_shuffles(spark):
        aligned = align_documents(docs, files, id_col, text_col, with_groups=False).withColumn("row", F.monotonically_increasing_id())
        aligned.write.option("compression", "zstd").parquet(folder)
    aligned = spark.read.parquet(folder)
    return aligned.join(weigh_links(aligned, part_pairs), "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
