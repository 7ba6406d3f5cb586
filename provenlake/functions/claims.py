"""What sets two claims apart: numbers on both sides, or the parity of negations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: number words below twenty, and the tens.
UNITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
#: Fixed: negators; words that end in n't count too, and "no" does not.
NEGATORS = ["not", "never", "cannot", "none", "neither", "nor"]


def claim_tokens(c: Column) -> Column:
    """Lower-case ASCII words with apostrophes; curly ones are straightened."""
    return F.regexp_extract_all(F.translate(F.lower(c), "‘’", "''"), F.lit("([a-z0-9']+)"), 1)


def _lookup(words: list[str], token: Column, first: int, step: int) -> Column:
    place = F.array_position(F.array(*[F.lit(w) for w in words]), token)
    return F.when(place > 0, (place - 1) * step + first)


def read_numbers(c: Column) -> Column:
    """The distinct numbers of a text, digits and words alike; a ten and a following unit are one number."""
    t = claim_tokens(c)
    unit = lambda x: _lookup(UNITS, x, 0, 1)
    ten = lambda x: _lookup(TENS, x, 20, 10)
    small = lambda x: F.when(unit(x).between(1, 9), unit(x))

    def at(tokens: Column, x: Column, i: Column) -> Column:
        before, after = F.get(tokens, i - 1), F.get(tokens, i + 1)
        joined = small(x).isNotNull() & ten(before).isNotNull()  # said with the ten before it
        value = F.when(x.rlike(r"^\d+$"), x.cast("double")).when(ten(x).isNotNull(), (ten(x) + F.coalesce(small(after), F.lit(0))).cast("double"))
        return F.when(joined, None).otherwise(F.coalesce(value, unit(x).cast("double")))

    found = F.transform(F.array(t), lambda tokens: F.transform(tokens, lambda x, i: at(tokens, x, i)))[0]
    return F.array_sort(F.array_distinct(F.filter(found, lambda v: v.isNotNull())))


def count_negators(c: Column) -> Column:
    return F.size(F.filter(claim_tokens(c), lambda t: t.isin(NEGATORS) | t.rlike(r".n't$")))


def claims_differ(a: Column, b: Column) -> Column:
    """number_conflict, negation_polarity, or null where nothing sets the claims apart."""
    na, nb = read_numbers(a), read_numbers(b)
    swapped = (F.size(F.array_except(na, nb)) > 0) & (F.size(F.array_except(nb, na)) > 0)
    return F.when(swapped, "number_conflict").when(count_negators(a) % 2 != count_negators(b) % 2, "negation_polarity")
