"""MinHash near-duplicates by a multi-index Hamming join.

Signatures. A text is the set of its distinct word shingles. Its signature has ``SYMBOLS`` b-bit minima (b = 16): the
least of the shingles' hashes under as many hash functions. Two sets agree in a symbol with a probability of
their Jaccard similarity; the distance of two signatures is the number of symbols that differ.

Meeting. Signatures are split into ``CHUNKS`` chunks of four symbols. By the pigeonhole principle two signatures that differ in
at most ``MOST_DIFFERENT`` = 2 x CHUNKS - 1 symbols have a chunk with at most one error. The allowed errors of each chunk are
enumerated: it gives a key for each symbol that may be wrong, made of the three others. So all pairs within that distance meet on
some key. At a similarity of 0.85 a pair lies beyond it with a probability of 1.4e-8; pairs more alike, far less often.

Confirming. Pairs within the distance are held against the threshold on their full sets. Where more than ``SMALL_GROUP``
documents meet on a key, each is compared with the group's first one; if that puts all of them into one component, nothing is
left to compare. The members of all other large groups meet once more by exact prefixes of their sets, rare shingles first
(``fragment_join.settled``), which is exact and never makes the pairs of a group.

Copies (equal sets) are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fragment_join
from ._base import durable
from ._shingles import chunks, mix, shingle_sets
from .components import connected_further

SHINGLE = 5
THRESHOLD = Fraction(85, 100)
CHUNKS, PER_CHUNK = 12, 4
SYMBOLS = CHUNKS * PER_CHUNK
MOST_DIFFERENT = 2 * CHUNKS - 1
SMALL_GROUP = 32
_U = np.uint64
_TIMES = np.random.default_rng(77).integers(1, 2**63, SYMBOLS, dtype=np.uint64) * _U(2) + _U(1)
_PLUS = np.random.default_rng(78).integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def minima(g: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS 16-bit numbers for each set; all zero for an empty one. g: the sets' shingles, one set after the other."""
    out = np.zeros((len(sizes), SYMBOLS), dtype=np.uint16)
    full = np.flatnonzero(sizes)
    if len(full):
        starts, spread = (np.cumsum(sizes) - sizes)[full], mix(g ^ _U(0x6C8E9CF570932BD5))
        for j in range(SYMBOLS):
            least = np.minimum.reduceat(spread * _TIMES[j] + _PLUS[j], starts)
            out[full, j] = (mix(least) & _U(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """A row for each signature: a key for each chunk and each of its symbols that may be wrong."""
    out = np.empty((len(signatures), SYMBOLS), dtype=np.uint64)
    wide = signatures.astype(np.uint64)
    for c in range(CHUNKS):
        for wrong in range(PER_CHUNK):
            key = np.full(len(wide), c * PER_CHUNK + wrong + 1, dtype=np.uint64)
            for j in range(PER_CHUNK):
                if j != wrong:
                    key = mix(key * _U(0xD6E8FEB86659FD93) + wide[:, c * PER_CHUNK + j])
            out[:, c * PER_CHUNK + wrong] = key
    return out


def _sign(k: int):
    """doc_id, digest, text -> doc_id, digest, n_shingles, node, signature (four symbols in each number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in chunks(batch.column(2).cast(pa.binary())):
                g, sizes = shingle_sets(texts, k)
                packed = minima(g, sizes).view(np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(texts)), batch.column(1).slice(a, len(texts)), pa.array(sizes.astype(np.int64)), pa.array(fragment_join.node_ids(g, sizes).view(np.int64)), fragment_join.lists_of(packed.ravel(), np.full(len(packed), packed.shape[1]))],
                    names=["doc_id", "digest", "n_shingles", "node", "signature"],
                )

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, signature -> key, node."""
    for batch in batches:
        packed = batch.column(1).flatten().to_numpy()
        keys = chunk_keys(packed.view(np.uint16).reshape(batch.num_rows, SYMBOLS))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), SYMBOLS))], names=["key", "node"])


def _near(pairs: DataFrame, nodes: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) within MOST_DIFFERENT symbols whose sizes allow for a link."""
    about = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    met = pairs.join(about("a"), "a").join(about("b"), "b")
    quarter = lambda x, shift: (F.shiftright(x, shift).bitwiseAND(F.lit(0xFFFF)) != 0).cast("int")
    differ = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda total, x: total + quarter(x, 0) + quarter(x, 16) + quarter(x, 32) + quarter(x, 48))
    return met.where(fragment_join.may_link(F.col("n_a"), F.col("n_b"), threshold) & (differ <= MOST_DIFFERENT)).select("a", "b")


def _pairs_in_groups(members: DataFrame) -> DataFrame:
    """a, b: the pairs of each key's nodes. members: key, node; at most SMALL_GROUP of a key."""
    groups = members.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return groups.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def near_duplicates(docs: DataFrame, threshold: Fraction = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    The distance is made for thresholds of 0.85 or more; below it links may be lost more often than stated above.
    Defined results: null and word-less texts have no shingles and link with nothing; texts are read whole; repeated rows
    (equal ids or texts) are documents of their own, which link as their texts do; rows without an id link as well, but a null
    id is never a component's id unless no row of it has one; ids may be of any type that has an order; an empty
    table gives an empty result; extra columns are ignored.
    """
    return linked_rows(docs, threshold, k, id_col, text_col).drop("digest")


def linked_rows(docs: DataFrame, threshold: Fraction = THRESHOLD, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``near_duplicates``, with the digest of each row's text."""
    t = Fraction(threshold)
    rows = fragment_join.signed_rows(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    signed = durable(rows.mapInArrow(_sign(k), f"doc_id {id_type}, digest long, n_shingles long, node long, signature array<long>"))
    nodes = fragment_join.nodes_of(signed)

    keys = nodes.select("node", "signature").mapInArrow(_keys, "key long, node long")
    met = durable(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("leader")).where("members > 1"))
    members = keys.join(met, "key")
    small = _pairs_in_groups(members.where(F.col("members") <= SMALL_GROUP).select("key", "node"))
    led = members.where((F.col("members") > SMALL_GROUP) & (F.col("leader") != F.col("node"))).select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = durable(_near(durable(small.unionByName(led).distinct()), nodes, t))
    maps = connected_further([], durable(fragment_join.pairs_that_link(pairs, fragment_join.pair_sets(pairs, nodes, rows, k), t)))

    large = met.where(F.col("members") > SMALL_GROUP)
    if not large.isEmpty():
        maps = fragment_join.settled(keys.join(large, "key"), maps, rows, nodes, t, k, parity=False)
    return fragment_join.with_component(signed, nodes, maps)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, in their own columns, with one of each component: a row with the smallest id.

    Of rows that are equal in id and text one stays; rows without an id stay only where their component has no row with one.
    """
    return fragment_join.first_of_each(docs, linked_rows(docs, id_col=id_col, text_col=text_col, **options), id_col, text_col)


ORACLE = """
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])
                                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
    sizes AS (SELECT d.doc_id, count(s.s) AS n FROM docs d LEFT JOIN sets s USING (doc_id) GROUP BY d.doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS (SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
    reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
    SELECT r.doc_id, s.n AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept FROM reach r JOIN sizes s USING (doc_id) GROUP BY r.doc_id, s.n"""
