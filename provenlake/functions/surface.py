"""Text that comes from or goes to people: framing of untrusted input, safe and short output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_INPUT, PIECE, MOST_PIECES = 4000, 1900, 5


def framed(text: Column, source: Column) -> Column:
    """The first 4000 characters between marks that say where they come from."""
    return F.concat(F.lit("[UNTRUSTED source="), source, F.lit("]\n"), F.substring(text, 1, MOST_INPUT), F.lit("\n[/UNTRUSTED]"))


def outbound(text: Column) -> Column:
    """Mass mentions are put between backticks, role mentions named as such."""
    quiet = F.regexp_replace(text, r"(?i)(@everyone|@here)", "`$1`")
    return F.regexp_replace(quiet, r"<@&\d+>", "[role-mention]")


def inline_safe(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(text, F.lit("`"), F.lit("\\`")), r"[\r\n]+", " "))


def pieces(text: str, most: int = PIECE) -> list[str]:
    """At most five pieces, cut at a line's end where one lies in the second half of a piece."""
    out = []
    while len(text) > most and len(out) < MOST_PIECES:
        cut = text.rfind("\n", 0, most + 1)
        cut = cut if cut >= most / 2 else most
        out.append(text[:cut])
        text = text[cut:].lstrip()
    return [*out, text][:MOST_PIECES] if text or not out else out


@F.pandas_udf(T.ArrayType(T.StringType()))
def outbound_pieces(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(lambda t: None if t is None else pieces(t))
