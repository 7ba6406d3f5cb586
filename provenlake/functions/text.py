"""Text functions whose white space, word and token classes are fixed by the data's contract."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: what counts as white space when claims are normalised (ASCII, no-break and wide spaces, line separators, byte order mark).
SPACE_CLASS = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE_CLASS}+", " ")


def query_terms(c: Column, most: int = 32) -> Column:
    """Letters, digits and underscores; at most 32 terms."""
    return F.slice(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1), 1, most)


def fold(c: Column) -> Column:
    """Lower case without diacritics: combining marks go, and letters that are composed with one become their base."""
    return F.regexp_replace(F.translate(F.lower(c), _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def _base(letter: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", letter) if unicodedata.category(x) != "Mn")


#: Lower-case letters of the alphabets that compose letters with marks (Latin, Greek, Cyrillic, and their extensions), and their bases.
_ACCENTED = "".join(x for x in map(chr, [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]) if x == x.lower() and len(_base(x)) == 1 and _base(x) != x)
_PLAIN = "".join(map(_base, _ACCENTED))


def index_terms(c: Column) -> Column:
    """Terms of the inverted index: letters and digits, case-folded, diacritics removed; an underscore splits.

    Terms are taken with their combining marks and folded one by one, and only those that aren't ASCII.
    """
    raw = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\p{Mn}*[\p{L}\p{N}][\p{L}\p{N}\p{Mn}]*)"), 1)
    return F.transform(raw, lambda x: F.when(F.octet_length(x) == F.char_length(x), x).otherwise(F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), r"\p{Mn}+", "")))


def term_counts(terms: Column) -> Column:
    """An array of (term, tf), by term: the runs of the sorted terms."""

    def runs(s: Column) -> Column:
        starts = F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.get(s, i - 2)))).otherwise(F.array().cast("array<int>"))
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: F.struct(F.element_at(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s) + 1) - i).alias("tf"))))[0]

    return F.transform(F.array(F.sort_array(terms)), runs)[0]


def estimate_tokens(c: Column) -> Column:
    """ASCII alphanumeric runs cost a sixth of their length, rounded up; any other visible character costs one."""
    runs = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9]+)"), 1)
    marks = F.regexp_count(c, F.lit(r"[^A-Za-z0-9\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"))
    return (F.aggregate(runs, F.lit(0), lambda a, r: a + F.ceil(F.length(r) / 6).cast("int")) + marks).cast("int")


def estimate_tokens_by_length(c: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(F.length(c) / 4).cast("int")


def breadcrumb(headings: Column) -> Column:
    return F.array_join(headings, " › ")


def strip_markdown_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.(md|markdown|mdx)$", "")


def strip_invisible(c: Column) -> Column:
    """Without zero-width characters, direction overrides and the byte order mark."""
    return F.regexp_replace(c, r"[\u200B-\u200D\u202A-\u202E\u2060-\u2064\u2066-\u2069\uFEFF]", "")


def cited_indices(c: Column) -> Column:
    """Distinct [n] of one or two digits, in the order of their first use."""
    return F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[(\d{1,2})\]"), 1)), lambda x: x.cast("int"))


def has_credential(c: Column) -> Column:
    """Secret keys and private-key blocks."""
    return c.rlike(r"\bsk-[A-Za-z0-9_-]{16,}|-----BEGIN [A-Z ]*PRIVATE KEY-----")


def money_micros(usd: Column) -> Column:
    """Whole micro-dollars, never below zero."""
    return F.greatest(F.round(usd * 1_000_000).cast("long"), F.lit(0).cast("long"))
