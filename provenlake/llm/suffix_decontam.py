"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items go into one automaton. The words of a document are streamed
through it; after each word the state tells the longest stretch ending there that also occurs in
some item. Where that length reaches the window, the words of the window are hit, and the state
knows the items that hold it. Items shorter than the window count as one window of their own length.

Only the automaton is broadcast, and its size is checked: items are packed into parts of at most
``PART_WORDS`` words (an automaton has at most twice as many states), and a larger benchmark takes
one pass for each part, with the hits carried along in the rows. Documents are never shuffled.

Defined results: null or word-less text has no words and no hits; very long texts are streamed whole;
repeated rows get equal results each; null item texts and items without words are ignored; equal item
texts count as items of their own, equal ids as one; an item with a null id hits words but isn't
listed; an empty table on either side gives no hits; further columns pass through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import LOWER, UPPER, bounded_batches, durable, quoted

WINDOW = 10
PART_WORDS = 400_000
#: ASCII letters are lower-cased; every other ASCII character but digits separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def normalised_words(text: str | bytes | None) -> list[bytes]:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return data.translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows' items at its states."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        self.go: list[dict[int, int]] = [{}]
        self.up, self.len = [-1], [0]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.least = min([window, *(len(ws) for _, ws in coded)])
        #: state of a window -> numbers of the items that hold it; state of a short item -> its length and number
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.ids = [i for i, _ in coded]
        for k, (_, ws) in enumerate(coded):
            at = 0
            for n, w in enumerate(ws, 1):
                at = self.go[at][w]
                if n >= window:
                    self.items.setdefault(self._above(at, window), set()).add(k)
            if len(ws) < window:
                self.short.setdefault(self._above(at, len(ws)), []).append((len(ws), k))
        self.reach = [self._above(v, window) if self.len[v] >= window else -1 for v in range(len(self.go))]
        pairs = {a * len(self.vocab) + b for _, ws in coded for a, b in zip(ws, ws[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), dtype=np.int64)

    def _above(self, v: int, n: int) -> int:
        """The state of the last n words of a state's longest string."""
        while v > 0 and self.len[self.up[v]] >= n:
            v = self.up[v]
        return v

    def _extend(self, last: int, w: int) -> int:
        go, up, length = self.go, self.up, self.len
        if (q := go[last].get(w)) is not None:
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        up.append(0)
        p = last
        while p >= 0 and w not in go[p]:
            go[p][w] = new
            p = up[p]
        if p >= 0:
            q = go[p][w]
            up[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        go, up, length = self.go, self.up, self.len
        twin = len(go)
        go.append(dict(go[q]))
        length.append(length[p] + 1)
        up.append(up[q])
        up[q] = twin
        while p >= 0 and go[p].get(w) == q:
            go[p][w] = twin
            p = up[p]
        return twin

    def scan(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of hit words (start, end) and the items found, for words coded by ``vocab`` (-1: none)."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not len(self.go[0]) or len(codes) < self.least:
            return spans, found
        go, up, length, window = self.go, self.up, self.len, self.window
        for a, b in self._stretches(codes):
            v = n = 0
            for i, w in enumerate(codes[a:b].tolist(), a):
                to = go[v].get(w)
                while to is None and v > 0:
                    v = up[v]
                    n = length[v]
                    to = go[v].get(w)
                if to is None:
                    continue
                v, n = to, n + 1
                if n >= window:
                    found |= self.items[self.reach[v]]
                    spans.append((i + 1 - window, i + 1))
                if self.short:
                    u = v
                    while u > 0:
                        for size, k in self.short.get(u, ()):
                            if size <= n:
                                found.add(k)
                                spans.append((i + 1 - size, i + 1))
                        u = up[u]
        return merge(spans), found

    def _stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches that can hold a window: all words known, all neighbours next to each other in some item."""
        if self.least == 1:
            good = codes >= 0
            edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
            return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        key = codes[:-1] * len(self.vocab) + codes[1:]
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        good = (codes[:-1] >= 0) & (codes[1:] >= 0) & (self.pairs[at] == key)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
        return [(a, b + 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b + 1 - a >= self.least]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _parts(benchmark: DataFrame, id_col: str, text_col: str, window: int, part_words: int) -> Iterator[Automaton]:
    """Automata over at most ``part_words`` words each (an item larger than that is a part of its own); items come to the driver one partition at a time."""
    items = benchmark.select(quoted(id_col).cast("string").alias("i"), quoted(text_col).alias("t")).where(F.col("t").isNotNull())
    held, size = [], 0
    for row in items.toLocalIterator():
        ws = normalised_words(row.t)
        if held and size + len(ws) > part_words:
            yield Automaton(held, window)
            held, size = [], 0
        held.append((row.i, ws))
        size += len(ws)
    yield Automaton(held, window)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS, keep: list[str] | None = None) -> DataFrame:
    """rec (a struct of the kept columns of docs but the text), text, n_words, spans (hit words, start to end), items (ids as strings)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col]
    rec = F.struct(*[quoted(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = bounded_batches(docs).select(rec.alias("rec"), quoted(text_col).cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(_SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = rows.schema
    sc = docs.sparkSession.sparkContext
    for k, automaton in enumerate(_parts(benchmark, item_id_col, item_text_col, window, part_words)):
        if k:
            rows = durable(rows)
        rows = rows.mapInArrow(_scanner(sc.broadcast(automaton)), schema)
    return rows


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        code = auto.vocab.get
        for batch in batches:
            n_words, spans, items = [], [], []
            old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, (had, listed) in zip(batch.column("text").cast(pa.binary()), old, strict=True):
                ws = normalised_words(text.as_py())
                codes = np.fromiter((code(w, -1) for w in ws), dtype=np.int64, count=len(ws))
                at, found = auto.scan(codes)
                if had:
                    at = merge(at + [(x["start"], x["end"]) for x in had])
                n_words.append(len(ws))
                spans.append([{"start": a, "end": b} for a, b in at])
                items.append(sorted({auto.ids[k] for k in found if auto.ids[k] is not None} | set(listed)))
            names = ["n_words", "spans", "items"]
            columns = [pa.array(x, type=batch.schema.field(n).type) for n, x in zip(names, (n_words, spans, items), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rec"), batch.column("text"), *columns], schema=batch.schema)

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = find_spans(docs, benchmark, window, keep=[id_col])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]).cast("long"))
    return rows.select(
        F.col("rec").getField(id_col).alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _cut(text: str | None, spans: list[dict] | None) -> str | None:
    """The text without the words of the spans; white space and marks that stood between cut words go with them."""
    if not spans:
        return text
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
    out, done = [], 0
    for x in spans:
        out.append(data[done : at[x["start"]][0]])
        done = at[x["end"] - 1][1]
    return b"".join([*out, data[done:]]).decode("utf-8", "surrogatepass")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, in their own columns, without what they share with the benchmark.

    A document of which more than ``max_coverage`` of all words is hit goes; from the others the hit
    spans are cut out of the text (``n_chars``, where there is one, follows). Untouched documents
    stay as they are.
    """
    rows = find_spans(docs, benchmark, window, text_col)
    n_hit = F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    rows = rows.where((F.size("spans") == 0) | (n_hit <= max_coverage * F.col("n_words")))
    cut = F.udf(_cut_many, "string", useArrow=True)
    rows = rows.withColumn("clean", F.when(F.size("spans") == 0, F.col("text")).otherwise(cut("text", "spans")))

    def column(c: str):
        if c == text_col:
            return F.col("clean").alias(c)
        if c == "n_chars":
            return F.when(F.size("spans") == 0, F.col("rec").getField(c)).otherwise(F.length("clean").cast(docs.schema[c].dataType)).alias(c)
        return F.col("rec").getField(c).alias(c)

    return rows.select(*[column(c) for c in docs.columns])


def _cut_many(text, spans):
    return _cut(text, [{"start": x["start"], "end": x["end"]} for x in spans])


def _sql(window: int) -> str:
    """The same result in DuckDB."""
    fold = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH items AS (SELECT item_id, {fold} AS w FROM benchmark WHERE text IS NOT NULL),
    windows AS (SELECT DISTINCT item_id, list_slice(w, i, i + size - 1) AS g, size FROM (SELECT item_id, w, least(len(w), {window}) AS size, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM items WHERE len(w) > 0)),
    docs AS (SELECT doc_id, coalesce({fold}, []) AS w FROM documents),
    sizes AS (SELECT DISTINCT size FROM windows),
    spots AS (SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
    found AS (SELECT s.doc_id, s.i, s.size, x.item_id FROM spots s JOIN windows x ON s.g = x.g AND s.size = x.size),
    hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(c, ',' ORDER BY c) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS c FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)"""


ORACLE = _sql(WINDOW)
