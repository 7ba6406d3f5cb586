"""Distinct word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_OF_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OF_BYTE[IS_SPACE] = 0
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    if len(_POWERS.get(int(base), ())) < n:
        steps = np.full(max(n, 2 * CHUNK_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[int(base)] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[int(base)][:n]


def chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """(number of the first, texts): stretches of a column of texts of about CHUNK_BYTES together; a longer text is alone.

    Only one stretch at a time is turned into Python objects.
    """
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n + 1 > CHUNK_BYTES:
            yield start, texts.slice(start, i - start).to_pylist()
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield start, texts.slice(start).to_pylist()


def word_spans(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, a line end after each; where each word starts and ends in them; and the first byte of each text."""
    joined = b"\n".join(t or b"" for t in texts) + b"\n"
    data = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
    space = IS_SPACE[data]
    edge = np.diff(np.concatenate(([1], space.view(np.int8))))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    begins = np.cumsum([0] + [(len(t) if t else 0) + 1 for t in texts[:-1]])
    return data, start, end, begins


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each word."""
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_OF_BYTE[data] * _powers(_BASE, len(data)), dtype=np.uint64)))
    return mix((sums[end] - sums[start]) * _powers(_BASE_INV, len(data))[start])


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, ASCII letters lower-cased, and the number of the text it stands in."""
    data, start, end, begins = word_spans(texts, lower=True)
    return span_hashes(data, start, end), np.searchsorted(begins, start, side="right") - 1


class RunHashes:
    """Two hashes of any stretch of words, from running sums over the words' hashes."""

    def __init__(self, words: np.ndarray):
        self.sums = []
        for base, inverse in ((_BASE, _BASE_INV), (_BASE_INV, _BASE)):
            power = _powers(base, max(len(words), 1))[: len(words)]
            self.sums.append((np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(words ^ base) * power, dtype=np.uint64))), _powers(inverse, len(words) + 1)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows: the two hashes of the words from each start to before each end."""
        return np.stack([mix((sums[end] - sums[start]) * power[start] + (end - start).astype(np.uint64)) for sums, power in self.sums])


def shingle_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, one text after the other, and the number of each text's.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    h, doc = word_hashes(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    n_all = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    which = np.repeat(np.arange(len(texts)), n_all)
    at = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(n_all) - n_all, n_all)
    padded = np.concatenate((h, np.zeros(k, dtype=np.uint64)))
    words_in = np.minimum(n_words[which], k)
    g = mix(_U(k) + np.zeros(len(at), dtype=np.uint64))
    for j in range(k):
        g = np.where(j < words_in, mix(g * _U(0xD6E8FEB86659FD93) + padded[at + j]), g)
    bounds = np.concatenate(([0], np.cumsum(n_all)))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            g[a:b].sort()
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (which[1:] != which[:-1])
    return g[new], np.bincount(which[new], minlength=len(texts))
