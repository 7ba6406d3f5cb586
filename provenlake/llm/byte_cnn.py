"""Language identification with a byte convolutional network.

Bytes are embedded, convolved with filters of several widths, max-pooled over fixed-length windows
and classified by softmax. Training is plain numpy on windows of a bounded sample of labelled texts
(up to ``SAMPLE_PER_LANG`` texts of each language and ``SAMPLE_TEXTS`` of all, but one of every language at
least; ``WINDOWS_PER_TEXT`` windows of each); prediction takes
every window of every whole text, in batches, and averages the windows' probabilities by the letters
they hold.

Defined results: text that is null or has no letter is ``und`` with score 0; so is everything if no
labelled row may be learned from; with one learned language that is the answer, with score 1; of equally likely languages the first by name is
taken; very long texts take more windows; repeated rows get equal results each (and count once each in the
sample); an empty table gives an empty result; further columns pass through ``identify`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import bounded_batches, durable, hash_sample, held_out, quoted

SAMPLE_PER_LANG = 300
SAMPLE_TEXTS = 120_000
WINDOWS_PER_TEXT = 4
LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 6
EPOCHS = 12
BLOCK_WINDOWS = 512
BLOCK_TEXTS = 256
SYMBOLS = 96



def _symbol(byte: int) -> int:
    """0 pads, 1 is white space and controls, 2 digits, 3 other ASCII; then 26 letters without case, and 64 for the upper half."""
    if byte > 127:
        return 30 + byte % 64
    if chr(byte).isalpha():
        return 4 + ord(chr(byte).lower()) - ord("a")
    return 2 if chr(byte).isdigit() else 1 if byte <= 32 or byte == 127 else 3


_SYMBOL = np.array([_symbol(b) for b in range(256)], dtype=np.uint8)
_LETTER_BYTE = np.array([65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])


def windows(data: bytes, length: int = LENGTH) -> np.ndarray:
    """Symbols of all windows of a text, the last one padded; windows overlap by the widest filter less one."""
    step = length - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - max(WIDTHS) + 1) // step))
    padded = np.zeros(n * step + max(WIDTHS) - 1, dtype=np.uint8)
    padded[: len(data)] = _SYMBOL[np.frombuffer(data, dtype=np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(padded, length)[::step]


class ByteCNN:
    """Embedding, convolutions, max pooling, softmax; weights are numpy arrays."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (SYMBOLS, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (1 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), dtype=np.float32)

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width: what a pair of symbols (or a last single one) adds to each filter, so that a filter costs a look-up for every two bytes."""
        every = []
        for f in self.filters:
            one = [self.embed @ f[j] for j in range(len(f))]
            parts = [(one[j][:, None, :] + one[j + 1][None, :, :]).reshape(-1, f.shape[2]) for j in range(0, len(f) - 1, 2)]
            every.append(parts + ([one[-1]] if len(f) % 2 else []))
        return every

    def pooled(self, x: np.ndarray, tables: list[list[np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Max over the window of each filter, and where it is. x: windows of symbols."""
        tables = tables or self.tables()
        pair = x[:, :-1].astype(np.int32) * SYMBOLS + x[:, 1:]
        tops, places = [], []
        for w, parts in zip(WIDTHS, tables, strict=True):
            n = x.shape[1] - w + 1
            total = None
            for k, table in enumerate(parts):
                at = pair[:, 2 * k : 2 * k + n] if 2 * k + 1 < w else x[:, 2 * k : 2 * k + n]
                got = table.take(at, axis=0)
                total = got if total is None else np.add(total, got, out=total)
            place = total.argmax(axis=1) if self.training else None
            tops.append(total.max(axis=1) if place is None else np.take_along_axis(total, place[:, None, :], axis=1)[:, 0])
            places.append(place)
        return np.concatenate(tops, axis=1), places

    training = False

    def probabilities(self, x: np.ndarray, tables=None) -> np.ndarray:
        top, _ = self.pooled(x, tables)
        return self._softmax(np.maximum(top + self.bias, 0))

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCNN:
        """Adam on the cross-entropy; the gradient passes through the place of each maximum."""
        rng = np.random.default_rng(seed)
        self.training = True
        mean = [np.zeros_like(w) for w in self.weights]
        square = [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                xs, ys = x[order[a : a + batch]], y[order[a : a + batch]]
                step += 1
                for w, g, m, s in zip(self.weights, self._gradients(xs, ys), mean, square, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.training = False
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        top, places = self.pooled(x)
        h = np.maximum(top + self.bias, 0)
        d = self._softmax(h)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        d_top = (d @ self.out.T) * (h > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters = []
        rows = np.arange(len(x))[:, None]
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part = d_top[:, k * FILTERS : (k + 1) * FILTERS]
            d_f = np.zeros_like(f)
            for j in range(w):
                at = x[rows, places[k] + j]
                d_f[j] = np.einsum("nfe,nf->ef", self.embed[at], part)
                np.add.at(d_embed, at, part[:, :, None] * f[j].T[None])
            d_filters.append(d_f)
        return [d_embed, *d_filters, d_top.sum(axis=0), h.T @ d, d.sum(axis=0)]

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each text; texts without a letter must be sorted out before."""
        tables = self.tables()
        sums = np.zeros((len(texts), len(self.langs)))
        held, owner, size = [], [], 0

        def flush():
            x = np.concatenate(held)
            who = np.repeat([o for o, _ in owner], [n for _, n in owner])
            for a in range(0, len(x), BLOCK_WINDOWS):
                block = x[a : a + BLOCK_WINDOWS]
                weight = _LETTER_SYMBOL[block].sum(axis=1) + 1e-3
                np.add.at(sums, who[a : a + BLOCK_WINDOWS], self.probabilities(block, tables) * weight[:, None])

        for i, text in enumerate(texts):
            w = windows(text or b"")
            held.append(w)
            owner.append((i, len(w)))
            size += len(w)
            if size >= BLOCK_WINDOWS:
                flush()
                held, owner, size = [], [], 0
        if held:
            flush()
        share = sums / sums.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return [self.langs[b] for b in best], share[np.arange(len(texts)), best].tolist()


_LETTER_SYMBOL = np.zeros(SYMBOLS, dtype=np.float32)
_LETTER_SYMBOL[np.unique(_SYMBOL[_LETTER_BYTE])] = 1


def _sampled(n: int):
    """doc text -> at most n windows of it, spread over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for text, lang in zip(batch.column("text").cast(pa.binary()), batch.column("lang"), strict=True):
                w = windows(text.as_py())
                for k in np.unique(np.linspace(0, len(w) - 1, min(n, len(w))).astype(int)):
                    langs.append(lang.as_py())
                    out.append(w[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array(out, type=pa.binary())], names=["lang", "window"])

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, epochs: int = EPOCHS) -> ByteCNN | None:
    """A network learned from the rows that aren't held out; None if there are none.

    The driver gets at most SAMPLE_TEXTS x WINDOWS_PER_TEXT windows of LENGTH bytes, those of one text of each id in the sample.
    Of up to MOST_LABELS languages none is left out: the more there are, the fewer texts each gives. The sample is drawn by
    a hash of the id, among the texts that have a letter.
    """
    rows = bounded_batches(docs).select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"), quoted(lang_col).alias("lang"))
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.where(F.col("text").rlike(r"\p{L}"))
    chosen, _ = hash_sample(durable(usable.select("doc_id", "lang")), "lang", "doc_id", per_lang, SAMPLE_TEXTS)
    texts = usable.join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])  # at most SAMPLE_TEXTS ids
    texts = texts.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = texts.select("text", "lang").mapInArrow(_sampled(WINDOWS_PER_TEXT), "lang string, window binary").toArrow()
    if not got.num_rows:
        return None
    pairs = sorted(zip(got.column("lang").to_pylist(), got.column("window").to_pylist(), strict=True))
    langs = sorted({p[0] for p in pairs})
    x = np.frombuffer(b"".join(p[1] for p in pairs), dtype=np.uint8).reshape(len(pairs), LENGTH)
    y = np.array([langs.index(p[0]) for p in pairs])
    net = ByteCNN(langs)
    return net.fit(x, y, epochs) if len(langs) > 1 else net


def _apply(shared, out: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            lang, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            known = np.flatnonzero(batch.column("has_letter").to_numpy(zero_copy_only=False)) if net is not None else []
            texts = batch.column("text").cast(pa.binary())
            for a in range(0, len(known), BLOCK_TEXTS):
                some = known[a : a + BLOCK_TEXTS]
                for i, p, s in zip(some, *net.predict(texts.take(pa.array(some)).to_pylist()), strict=True):
                    lang[i], score[i] = p, s
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in out], pa.array(lang), pa.array(score, type=pa.float64())], names=[*out, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: ByteCNN | None, text_col: str = "text", keep: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """rec (a struct of the kept columns but the text), text, lang_pred, score. Without ``with_text`` the text isn't handed back."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col]
    text = quoted(text_col).cast("string")
    rec = F.struct(*[quoted(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    rows = bounded_batches(docs).select(rec.alias("rec"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    out = ["rec", "text"] if with_text else ["rec"]
    schema = rows.select(*out, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(net), out), schema)


def keep_identified(docs: DataFrame, net: ByteCNN | None, text_col: str = "text", langs: list[str] | None = None, least_score: float = 0.0, lang_col: str | None = None) -> DataFrame:
    """The documents, in their own columns, without those in no language, in none of ``langs``, or below ``least_score``.

    ``lang_col`` names a column that takes the language found. Without a network nothing is known of any
    language: then all texts with a letter stay, with the language they had.
    """
    if net is None:
        return docs.where(F.coalesce(quoted(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    found = identify(docs, net, text_col)
    wanted = (F.col("lang_pred") != "und") & (F.col("score") >= least_score)
    if langs is not None:
        wanted &= F.col("lang_pred").isin(langs)
    column = lambda c: F.col("text") if c == text_col else F.col("lang_pred") if c == lang_col else F.col("rec").getField(c)
    return found.where(wanted).select(*[column(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
