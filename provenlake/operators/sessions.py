"""Search in session messages: stemmed terms ranked by BM25, with a snippet; plain substring search as the fallback."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import index_terms
from . import search

SNIPPET_TOKENS, FALLBACK_CHARS = 16, 120

#: Fixed: suffixes of Porter's algorithm (Porter 1980), steps 2 to 4, and what replaces them.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """c for each consonant, v for each vowel; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or (ch == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _cvc(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for steps in (STEP_2, STEP_3):
        for end, new in sorted(steps, key=lambda s: -len(s[0])):
            if word.endswith(end):
                word = word[: -len(end)] + new if _measure(word[: -len(end)]) else word
                break
    for end in sorted(STEP_4, key=lambda e: -len(e)):
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _cvc(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all(terms: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for series in terms:
        if len(known) > 200_000:
            known.clear()
        yield series.map(lambda ts: None if ts is None else [known.setdefault(t, stem(t)) for t in ts])


def session_search(messages: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, message_id, bm25, rank, snippet. messages: message_id, text; queries: query_id, text."""
    stems = messages.select("message_id", F.array_join(stem_all(index_terms(F.col("text"))), " ").alias("stems"))
    wanted = queries.select("query_id", stem_all(index_terms(F.col("text"))).alias("wanted"))
    hits = search.lexical_hits(wanted.select("query_id", F.explode("wanted").alias("term")), stems, "message_id", "stems", pool=k)
    found = hits.select("query_id", F.col("doc_id").alias("message_id"), "bm25", F.col("lex_rank").alias("rank"))
    met = found.join(messages.select("message_id", "text"), "message_id").join(wanted, "query_id")
    # A snippet costs far more than its row: as many tasks as a shuffle has, however small the rows are.
    met = met.repartition(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("stems", stem_all(index_terms(F.col("text"))))
    return met.select("query_id", "message_id", "bm25", "rank", snippet(F.col("text"), F.col("stems"), F.col("wanted")).alias("snippet"))


#: A token with its combining marks, as ``index_terms`` takes it.
_TOKEN = r"\p{Mn}*[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*"


def snippet(text: Column, stems: Column, wanted: Column, size: int = SNIPPET_TOKENS) -> Column:
    """The ``size`` tokens of a text that hold most of the wanted stems, hits in brackets, dots where the text goes on.

    Windows begin at a hit, or as far before the end as they are long. The one with the most different wanted stems is taken, of those the one with
    the most hits, of those the first. stems: of each token, in order.
    """
    # Each token meets the wanted stems once: its place among them, 0 for none.
    places = F.transform(stems, lambda s: F.array_position(wanted, s))
    whole = F.struct(F.regexp_extract_all(text, F.lit(f"({_TOKEN})"), 1).alias("tokens"), F.split(text, _TOKEN, -1).alias("gaps"), F.transform(places, lambda x: x > 0).alias("hits"), places.alias("places"))

    def best_start(w: Column) -> Column:
        last = F.greatest(F.size(w["tokens"]) - size, F.lit(0))
        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w["hits"]) - 1, F.lit(0))), lambda i: F.coalesce(F.get(w["hits"], i), F.lit(False)))
        starts = F.array_distinct(F.transform(at, lambda i: F.least(i, last)))

        def score(i: Column) -> Column:
            own = F.filter(F.slice(w["places"], i + 1, F.lit(size)), lambda x: x > 0)
            return F.struct(F.size(F.array_distinct(own)).alias("different"), F.size(own).alias("n"), (-i).alias("place"))

        return -F.coalesce(F.array_max(F.transform(starts, score))["place"], F.lit(0))

    def render(w: Column) -> Column:
        def cut(start: Column) -> Column:
            n = F.least(F.lit(size), F.size(w["tokens"]) - start)
            word = lambda i: F.when(F.get(w["hits"], i), F.concat(F.lit("["), F.get(w["tokens"], i), F.lit("]"))).otherwise(F.get(w["tokens"], i))
            words = F.transform(F.sequence(start, start + n - 1), lambda i: F.concat(F.when(i > start, F.get(w["gaps"], i)).otherwise(""), word(i)))
            return F.concat(F.when(start > 0, "…").otherwise(""), F.array_join(words, ""), F.when(start + n < F.size(w["tokens"]), "…").otherwise(""))

        return F.when(F.size(w["tokens"]) == 0, "").otherwise(F.transform(F.array(best_start(w)), cut)[0])

    return F.transform(F.array(whole), render)[0]


def plain_search(messages: DataFrame, part: str, most: int = 10) -> DataFrame:
    """The newest messages that hold a part, without regard to ASCII case. messages: message_id, text, created_at."""
    return messages.where(F.lower("text").contains(part.lower())).orderBy(F.desc("created_at"), "message_id").limit(most).select("message_id", F.substring("text", 1, FALLBACK_CHARS).alias("snippet"))
