"""Order within a key without gathering the key: rows go into buckets of their order, and only one row a bucket sees the others.

``bucket`` is the order divided by a width; what a bucket needs from those before it (how many rows, the last one) comes from
a table of one row a bucket. So a key with all rows is as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..materialise import durable

WIDTH = 4096


def bucket_of(order: Column, width: int = WIDTH) -> Column:
    return F.floor(order / F.lit(width)).cast("long")


def _buckets(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """One row a bucket, with the number of rows in all buckets before it."""
    sizes = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"), *more)
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def numbered(rows: DataFrame, keys: list[str], order: str, name: str = "idx", width: int = WIDTH) -> DataFrame:
    """Adds the place of each row among those of its key, from 0. order: a whole number, no two alike in a key."""
    df = rows.withColumn("__bucket", bucket_of(F.col(order), width))
    rank = F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(order)) - 1
    met = df.withColumn("__rank", rank).join(_buckets(df, keys).drop("__n"), [*keys, "__bucket"])
    return met.withColumn(name, (F.col("__before") + F.col("__rank")).cast("long")).drop("__bucket", "__rank", "__before")


def with_previous(rows: DataFrame, keys: list[str], order: str, value: str, name: str, first: Column, width: int = WIDTH) -> DataFrame:
    """Adds the value of the row before each one in its key; ``first`` for a key's first row."""
    df = rows.withColumn("__bucket", bucket_of(F.col(order), width))
    ends = df.groupBy(*keys, "__bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("__end"))
    border = ends.withColumn("__border", F.lag("__end").over(Window.partitionBy(*keys).orderBy("__bucket"))).drop("__end")
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(*keys, "__bucket").orderBy(order))
    met = df.withColumn("__inside", inside).join(border, [*keys, "__bucket"])
    before = F.coalesce("__inside", "__border")
    return met.withColumn(name, F.when(before.isNull(), first).otherwise(before["v"])).drop("__bucket", "__inside", "__border")


def counted_upto(rows: DataFrame, keys: list[str], order: str, asked: DataFrame, upto: str, name: str, width: int = WIDTH) -> DataFrame:
    """asked (keys, upto, ...) with how many rows of the key have an order of at most ``upto``.

    The buckets before come as one sum; of the bucket itself its rows are compared.
    """
    df = rows.select(*keys, F.col(order).alias("__order"), bucket_of(F.col(order), width).alias("__bucket"))
    ask = durable(asked.withColumn("__ask", F.monotonically_increasing_id()).withColumn("__at", bucket_of(F.col(upto), width)))
    each = ask.select("__ask", *keys, "__at", F.col(upto).alias("__upto"))
    inside = each.join(df.withColumnRenamed("__bucket", "__at"), [*keys, "__at"]).where("__order <= __upto").groupBy("__ask").agg(F.count(F.lit(1)).alias("__inside"))
    # The last bucket before the one asked for: questions and buckets in one order, the sum carried on.
    sums = _buckets(df, keys).select(*keys, F.col("__bucket").alias("__at"), (F.col("__before") + F.col("__n")).alias("__sum"), F.lit(None).cast("long").alias("__ask"), F.lit(1).alias("__kind"))
    both = sums.unionByName(each.select(*keys, "__at", F.lit(None).cast("long").alias("__sum"), "__ask", F.lit(0).alias("__kind")))
    carried = F.last("__sum", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, -1))
    earlier = both.withColumn("__earlier", carried).where("__kind = 0").select("__ask", "__earlier")
    met = ask.join(earlier, "__ask", "left").join(inside, "__ask", "left")
    return met.withColumn(name, F.coalesce("__earlier", F.lit(0)) + F.coalesce("__inside", F.lit(0))).drop("__ask", "__at", "__earlier", "__inside")


def counted_within(rows: DataFrame, keys: list[str], time: Column, span: int, name: str) -> DataFrame:
    """Adds how many rows of the key lie within ``span`` before each row's time, both ends included, itself too. time: a whole number.

    A row is counted in its own stretch of that span and, as context, in the next one, so a key is as many tasks as it has stretches.
    """
    df = rows.withColumn("__time", time)
    of = lambda stretch, own: F.struct(stretch.cast("long").alias("n"), F.lit(own).alias("own"))
    stretch = F.floor(F.col("__time") / F.lit(span))
    both = df.withColumn("__in", F.explode(F.when(F.col("__time").isNull(), F.array(of(stretch, True))).otherwise(F.array(of(stretch, True), of(stretch + 1, False)))))
    within = Window.partitionBy(*keys, "__in.n").orderBy("__time").rangeBetween(-span, 0)
    return both.withColumn(name, F.count(F.lit(1)).over(within)).where("__in.own").drop("__time", "__in")


def running_before(rows: DataFrame, order: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds the sum of the values of all rows before each one; only the sums of the buckets, one row each, are ever in one task."""
    df = rows.withColumn("__bucket", bucket_of(F.col(order), width))
    sums = df.groupBy("__bucket").agg(F.sum(value).alias("__sum"))
    before = sums.select("__bucket", F.coalesce(F.sum("__sum").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__inside", inside).join(before, "__bucket").withColumn(name, F.col("__before") + F.col("__inside")).drop("__bucket", "__before", "__inside")
