"""Aliases: each value's first occurrence gives it the next free name of its prefix.

Two shuffles of distinct values, none of rows: the first occurrence is found by a map-side combined aggregate, and the
numbers come from distributed ranks: values are dealt to ranges of first occurrences, by quantiles, and each range starts
at the sum of the counts before it, so no prefix is numbered in one task. Groups (files) are numbered apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.functions.identity import alias_letters


def numbered(first: DataFrame, doublings: int = 10) -> DataFrame:
    """first (group, value, prefix, ord) with nth, from 1, by group and prefix in the order of ord."""
    n, keys = 2**doublings, ["group", "prefix"]
    # Bounds by approximate quantiles, so that buckets are of like size however ord is spread; one row of n numbers.
    bounds = F.broadcast(first.agg(F.percentile_approx("ord", [i / n for i in range(1, n)], 10 * n).alias("bounds")))
    halves = F.array(*[F.lit(2**k) for k in reversed(range(doublings))])
    bucket = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.element_at("bounds", at + step) < F.col("ord"), at + step).otherwise(at))
    dealt = first.crossJoin(bounds).withColumn("bucket", bucket).drop("bounds")
    sizes = dealt.groupBy(*keys, "bucket").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = dealt.join(sizes.withColumn("before", before).drop("size"), [*keys, "bucket"])
    nth = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("ord", "value")) + F.col("before")
    return dealt.withColumn("nth", nth).drop("bucket", "before")


def aliases(df: DataFrame, value: str, ord: str, prefix: str | None = None, default_prefix: str = "公司", group: str | None = None) -> DataFrame:
    """group, value and alias of each distinct value of a group that isn't empty; a value keeps the prefix of its first occurrence."""
    label = F.coalesce(F.col(prefix), F.lit(default_prefix)) if prefix else F.lit(default_prefix)
    own = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    rows = df.select(own.alias("group"), F.col(value).cast("string").alias("value"), label.alias("prefix"), F.col(ord).cast("bigint").alias("ord")).filter(F.length("value") > 0)
    first = rows.groupBy("group", "value").agg(F.min(F.struct("ord", "prefix")).alias("first")).select("group", "value", "first.prefix", "first.ord")
    out = numbered(first)
    return out.select("group", "value", F.concat(F.lit("["), "prefix", alias_letters(F.col("nth")), F.lit("]")).alias("alias"))


def with_alias(df: DataFrame, value: str, ord: str, prefix: str | None = None, default_prefix: str = "公司", out: str = "alias") -> DataFrame:
    """df with each value's alias; empty values and nulls stay as they are."""
    names = aliases(df, value, ord, prefix, default_prefix).select(F.col("value").alias("_value"), F.col("alias").alias("_alias"))
    return df.join(names, F.col(value).cast("string") == F.col("_value"), "left").withColumn(out, F.coalesce("_alias", F.col(value).cast("string"))).drop("_value", "_alias")
