"""Quality rules under weak supervision (DataFrame functions only).

Each rule looks at a whole text and votes good (1), bad (-1) or abstains (0). No rule is trusted by
itself: expectation-maximisation estimates how often each rule votes each way on good and on bad
texts, from the votes of all documents, and a document's posterior probability of being good
decides. Votes are counted per pattern first (at most 3^rules rows, whatever the corpus), so the
estimation works on a table of fixed size.

Defined results: null, empty or blank text has no words, fails the base rule and all rules abstain;
very long texts are read whole; repeated rows are judged each by itself, with equal results; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import durable, quoted, words

#: name, feature, good if feature is at most/at least, bad if beyond; the word count must reach the last value, else the rule abstains.
RULES = (
    ("symbols", "per_word_symbols", 0.02, 0.20, 1),
    ("shouting", "per_word_bangs", 0.05, 0.25, 3),
    ("capitals", "upper_share", 0.35, 0.70, 3),
    ("repeats", "repeat_share", 0.05, 0.15, 10),
    ("stutter", "stutter_share", 0.02, 0.20, 5),
    ("lines", "dup_line_share", 0.10, 0.30, 5),
    ("length", "shortness", 0.0, 0.5, 1),
    ("plain_words", "odd_word_share", 0.15, 0.35, 3),
    ("sentences", "odd_sentences", 0.0, 0.5, 30),
    ("word_size", "odd_word_size", 0.0, 0.5, 1),
)
ROUNDS = 25
WINDOW = 5


def _repeat_words(w: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more: the windows' starts in order, each adding what the one before didn't cover."""
    paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), paired)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules use, one row a document, from whole texts."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    df = docs.select(quoted(id_col).alias("doc_id"), text.alias("text"), words(text).alias("w"))
    df = df.withColumn("n_words", F.size("w").cast("long"))
    # A window's hash takes its five words; texts of fewer words have no window.
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int"))).otherwise(F.array().cast("array<int>"))
    at = lambda i, k: F.get(F.col("w"), i + k)
    df = df.withColumn("hashes", F.transform(starts, lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])))
    df = df.withColumn("twice", _repeat_words(F.col("w"), F.col("hashes")))
    twice = F.col("twice")
    same = lambda x, k: F.coalesce(F.get(twice, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(twice, k + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("starts", F.when(twice.isNotNull(), F.sort_array(F.transform(F.filter(twice, same), lambda x: x["i"]))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("starts", zero, lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    next_word = F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0)))
    stutter = F.size(F.filter(F.zip_with(F.col("w"), next_word, lambda a, b: a == b), lambda x: x))
    df = df.select(
        "doc_id", "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), stutter.alias("n_stutter"),
        F.regexp_count("text", F.lit(r"!")).alias("n_bangs"),
        F.regexp_count("text", F.lit(r"(?<![^\s])\p{L}+[.,;:?]?(?![^\s])")).alias("n_plain"),
        F.regexp_count("text", F.lit(r"[.?!](?![^\s])")).alias("n_ends"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).alias("n_upper"), F.regexp_count("text", F.lit(r"\p{L}")).alias("n_letters"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def votes(counts: DataFrame) -> DataFrame:
    """Adds ``votes``, an array with 1, 0 or -1 for each of RULES."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / n
    of = {
        "per_word_symbols": F.col("n_symbols") / n,
        "per_word_bangs": F.col("n_bangs") / n,
        "upper_share": F.col("n_upper") / F.greatest("n_letters", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / n,
        "stutter_share": F.col("n_stutter") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "odd_word_share": 1 - F.col("n_plain") / n,
        "odd_sentences": F.when((F.col("n_ends") / n).between(0.02, 0.4), 0.0).when((F.col("n_ends") / n).between(0.005, 0.6), 0.25).otherwise(1.0),
        "shortness": F.when(F.col("n_words") >= 25, 0.0).when(F.col("n_words") >= 10, 0.25).otherwise(1.0),
        "odd_word_size": F.when(mean.between(2.5, 9.5), 0.0).when(mean.between(1.5, 14.0), 0.25).otherwise(1.0),
    }
    each = [F.when(F.col("n_words") < least, 0).when(of[f] <= good, 1).when(of[f] > bad, -1).otherwise(0) for _, f, good, bad, least in RULES]
    return counts.withColumn("votes", F.array(*each))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Posterior probability of good for each vote pattern: votes, posterior.

    ``patterns``: votes, n (rows with that pattern); at most 3^rules rows. Class-conditional vote
    rates and the prior are re-estimated ``rounds`` times; an abstention tells nothing about the
    class. At first a pattern counts as bad where any rule says so. One good and one bad vote are
    added to the votes that each rate is taken from.
    """
    m = len(RULES)
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("p"))
    p = F.col("p")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def again(post: Column, _: Column) -> Column:
        good = F.zip_with(p, post, lambda x, q: x["n"] * q)
        bad = F.zip_with(p, post, lambda x, q: x["n"] * (1 - q))

        def rates(weight: Column) -> Column:
            n = lambda j, v: total(F.zip_with(p, weight, lambda x, k: F.when(x["votes"][j] == v, k).otherwise(0.0))) + 1.0
            return F.array(*[F.transform(F.array(F.struct(n(j, -1).alias("bad"), n(j, 1).alias("good"))), lambda c: F.array(F.log(c["bad"] / (c["bad"] + c["good"])), F.lit(0.0), F.log(c["good"] / (c["bad"] + c["good"]))))[0] for j in range(m)])

        model = F.struct(rates(good).alias("g"), rates(bad).alias("b"), F.log((total(good) + 1.0) / (total(bad) + 1.0)).alias("prior"))
        odds = lambda x, s: s["prior"] + sum((s["g"][j][x["votes"][j] + 1] - s["b"][j][x["votes"][j] + 1] for j in range(m)), F.lit(0.0))
        return F.transform(F.array(model), lambda s: F.transform(p, lambda x: 1.0 / (1.0 + F.exp(-odds(x, s)))))[0]

    start = F.transform(p, lambda x: F.when(F.array_contains(x["votes"], -1), 0.001).otherwise(0.999))
    fitted = one.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again).alias("post"))
    return fitted.select(F.explode(F.arrays_zip("p", "post")).alias("z")).select(F.col("z.p.votes").alias("votes"), F.col("z.post").alias("posterior"))


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, kept, posterior, votes."""
    seen = durable(votes(features(docs, id_col, text_col)))
    fitted = estimate(seen.groupBy("votes").agg(F.count(F.lit(1)).alias("n")))
    judged = seen.join(F.broadcast(fitted), "votes")  # at most 3^rules rows
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), F.round("posterior", 6).alias("posterior"), "votes",
    )


def _sql(rounds: int = ROUNDS, threshold: float = 0.5) -> str:
    """The production query in DuckDB, a CTE for each round of the estimation."""
    features = {
        "per_word_symbols": "n_symbols / k", "per_word_bangs": "n_bangs / k", "upper_share": "n_upper / greatest(n_letters, 1)", "repeat_share": "n_repeat_words / k",
        "stutter_share": "n_stutter / k", "dup_line_share": "n_dup_lines / greatest(n_lines, 1)", "odd_word_share": "1 - n_plain / k",
        "odd_sentences": "CASE WHEN n_ends / k BETWEEN 0.02 AND 0.4 THEN 0.0 WHEN n_ends / k BETWEEN 0.005 AND 0.6 THEN 0.25 ELSE 1.0 END",
        "shortness": "CASE WHEN n_words >= 25 THEN 0.0 WHEN n_words >= 10 THEN 0.25 ELSE 1.0 END",
        "odd_word_size": "CASE WHEN word_chars / k BETWEEN 2.5 AND 9.5 THEN 0.0 WHEN word_chars / k BETWEEN 1.5 AND 14.0 THEN 0.25 ELSE 1.0 END",
    }
    m = range(len(RULES))
    vote = ", ".join(f"CASE WHEN n_words < {least} THEN 0 WHEN ({features[f]})::DOUBLE <= {good} THEN 1 WHEN ({features[f]})::DOUBLE > {bad} THEN -1 ELSE 0 END AS v{j}" for j, (_, f, good, bad, least) in enumerate(RULES))
    names = ", ".join(f"v{j}" for j in m)
    parts = [f"""d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
    g AS (SELECT r, i, list_slice(w, i, i + {WINDOW - 1}) AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
    hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY r),
    f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
                 len(l) AS n_lines, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter, len(regexp_extract_all(text, '!')) AS n_bangs, len(list_filter(w, lambda x: regexp_full_match(x, '\\p{{L}}+[.,;:?]?'))) AS n_plain,
                 len(list_filter(w, lambda x: regexp_matches(x, '[.?!]$'))) AS n_ends, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\\p{{L}}')) AS n_letters, greatest(len(w), 1)::DOUBLE AS k FROM d LEFT JOIN hit USING (r)),
    x AS MATERIALIZED (SELECT *, {vote} FROM f),
    p AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM x GROUP BY {names}),
    q0 AS MATERIALIZED (SELECT *, CASE WHEN {" OR ".join(f"v{j} = -1" for j in m)} THEN 0.001 ELSE 0.999 END::DOUBLE AS q FROM p)"""]
    for k in range(1, rounds + 1):
        counts = ", ".join(f"coalesce(sum({w}) FILTER (v{j} = {v}), 0) + 1 AS {c}{s}{j}" for j in m for c, w in (("g", "n * q"), ("b", "n * (1 - q)")) for s, v in (("b", -1), ("g", 1)))
        parts.append(f"r{k} AS MATERIALIZED (SELECT ln((sum(n * q) + 1) / (sum(n * (1 - q)) + 1)) AS prior, {counts} FROM q{k - 1})")
        odds = " + ".join(f"CASE v{j} WHEN -1 THEN ln(gb{j} / (gb{j} + gg{j})) - ln(bb{j} / (bb{j} + bg{j})) WHEN 1 THEN ln(gg{j} / (gb{j} + gg{j})) - ln(bg{j} / (bb{j} + bg{j})) ELSE 0 END" for j in m)
        parts.append(f"q{k} AS MATERIALIZED (SELECT {names}, n, 1 / (1 + exp(-(prior + {odds}))) AS q FROM q{k - 1}, r{k})")
    failed = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"
    return "WITH " + ",\n    ".join(parts) + f"\n    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT {failed} AND q >= {threshold} AS kept, round(q, 6) AS posterior FROM x JOIN q{rounds} USING ({names})"


ORACLE = _sql()
