"""Dense vectors: cosine, normalisation, and the deterministic hash embedding."""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_DIMS = 256


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def l2_normalize(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.when(norm == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / norm))


def _units(text: str) -> list[bytes]:
    """UTF-16 code units, since n-grams are counted in them."""
    raw = text.encode("utf-16-le", "surrogatepass")
    return [raw[i : i + 2] for i in range(0, len(raw), 2)]


def _gram(units: list[bytes]) -> bytes:
    return b"".join(units).decode("utf-16-le", "replace").encode("utf-8", "replace")


def hash_vector(text: str) -> np.ndarray:
    """Character n-grams of 3 to 5 and words, each hashed to a place and a sign; unit length."""
    out = np.zeros(HASH_DIMS)
    norm = unicodedata.normalize("NFKC", text.lower())

    def add(token: bytes, weight: float) -> None:
        digest = hashlib.sha256(token).digest()
        out[struct.unpack(">I", digest[:4])[0] % HASH_DIMS] += weight if digest[4] & 1 == 0 else -weight

    units = _units(f"  {norm}  ")
    for n in (3, 4, 5):
        for i in range(len(units) - n + 1):
            add(_gram(units[i : i + n]), 1.0)
    for token in re.split(r"[^A-Za-z0-9_]+", norm):
        if token:
            add(f"T:{token}".encode(), 2.0)
    size = np.linalg.norm(out)
    return out / size if size else out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hash_embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(lambda t: None if t is None else hash_vector(t))
