from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

#: Rows that every operator on texts must bear: nulls, blanks, repeats, one very long text, other alphabets.
HARD = [
    (1, "plain words of a plain text, and some more of them here.", "en", "src0", 10),
    (2, None, "en", "src1", None),
    (3, "", None, None, 0),
    (4, " \n\t ", "en", "src1", 4),
    (5, "plain words of a plain text, and some more of them here.", "en", "src0", 10),
    (5, "plain words of a plain text, and some more of them here.", "en", "src0", 10),
    (6, "many words again " * 3000, "en", "src2", 0),
    (7, "ελληνικά και ψηφία 123 \U0001f600 \u00a0 τέλος", "el", "src3", 1),
    (8, "1234 5678 !!!", "en", "src1", 1),
    (None, "a row without an id", "en", "src1", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    """With columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(HARD, SCHEMA)
    clashing = ["score", "rec", "spans", "size", "key", "node", "n_words", "root", "digest", "copies", "label", "a.b"]
    return df.withColumns({c: F.lit(c) for c in clashing})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
