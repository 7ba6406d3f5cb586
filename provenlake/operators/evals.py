"""Evaluation: retrieval metrics, threshold sweeps, confusion of drift verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """tier, n, recall_1, recall_3, mrr; one row more, ``all``, over every query.

    hits: query_id, rank, relevant; queries: query_id, tier. Queries without a relevant hit count as zero.
    """
    first = hits.where("relevant").groupBy("query_id").agg(F.min("rank").alias("first"))
    met = queries.join(first, "query_id", "left")
    at = lambda k: F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0))
    return met.rollup("tier").agg(F.count(F.lit(1)).alias("n"), at(1).alias("recall_1"), at(3).alias("recall_3"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr")).select(F.coalesce("tier", F.lit("all")).alias("tier"), "n", "recall_1", "recall_3", "mrr")


def threshold_sweep(pairs: DataFrame, low: float = 0.50, high: float = 0.99, step: float = 0.01) -> DataFrame:
    """threshold, fn, fp, fn_net, fp_net. pairs: same, score, suppressed.

    Pairs are counted per step of their score first; running sums over the steps give every threshold, so
    the pairs are read once and never multiplied by the thresholds.
    """
    n = round((high - low) / step) + 1
    place = F.greatest(F.least(F.floor((F.col("score") - low) / step + 1e-9), F.lit(n - 1)), F.lit(-1)).cast("int")
    by = pairs.groupBy(place.alias("place")).agg(*[F.sum(c.cast("int")).alias(a) for a, c in (("same", F.col("same")), ("diff", ~F.col("same")), ("same_s", F.col("same") & F.col("suppressed")), ("diff_s", ~F.col("same") & F.col("suppressed")))])
    steps = pairs.sparkSession.range(n).select(F.col("id").cast("int").alias("t"))
    met = steps.join(F.broadcast(by))  # n steps on both sides
    above, below = F.col("place") >= F.col("t"), F.col("place") < F.col("t")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    out = met.groupBy("t").agg(total("same", below).alias("fn"), total("diff", above).alias("fp"), total("same_s", above).alias("lost"), total("diff_s", above).alias("saved"))
    return out.select(F.round(low + F.col("t") * step, 2).alias("threshold"), "fn", "fp", (F.col("fn") + F.col("lost")).alias("fn_net"), (F.col("fp") - F.col("saved")).alias("fp_net"))


def threshold_extremes(pairs: DataFrame, low: float = 0.50, high: float = 0.99, step: float = 0.01) -> DataFrame:
    """min_same, max_diff, first_free (the first threshold without a false positive, net of what is suppressed; null if none is): one row."""
    ends = pairs.agg(F.min(F.when(F.col("same"), F.col("score"))).alias("min_same"), F.max(F.when(~F.col("same"), F.col("score"))).alias("max_diff"))
    free = threshold_sweep(pairs, low, high, step).agg(F.min(F.when(F.col("fp_net") == 0, F.col("threshold"))).alias("first_free"))
    return ends.crossJoin(free)  # one row each


def confusion(rows: DataFrame, flagged: Column, changed: Column, stratum: str | None = None) -> DataFrame:
    """(stratum,) tp, fp, fn, tn, recall, precision."""
    n = lambda c: F.sum(c.cast("int"))
    df = rows.select(flagged.alias("flagged"), changed.alias("changed"), *([F.col(stratum).alias("stratum")] if stratum else []))
    out = (df.groupBy("stratum") if stratum else df).agg(
        n(F.col("flagged") & F.col("changed")).alias("tp"), n(F.col("flagged") & ~F.col("changed")).alias("fp"),
        n(~F.col("flagged") & F.col("changed")).alias("fn"), n(~F.col("flagged") & ~F.col("changed")).alias("tn"),
    )
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b))
    return out.withColumn("recall", ratio(F.col("tp"), F.col("fn"))).withColumn("precision", ratio(F.col("tp"), F.col("fp")))
