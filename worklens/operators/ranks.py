"""Exact ranks and quantiles of columns and groups, without a task that holds a whole group.

Values are counted first, the counts are dealt to tasks by ranges of (group, value), and the rows of earlier
ranges are added to the running counts of each range. A hot group spreads over as many ranges as it fills.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from worklens.sources.staging import stage


def null_safe_left(left: DataFrame, right: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Left join on expressions of the left side that equal the named columns of the right side, null equal to null;
    the right side's keys are dropped."""
    named = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (e.eqNullSafe(F.col(f"_key_{k}")) for k, e in keys.items()))
    return left.join(named, same, "left").drop(*(f"_key_{k}" for k in keys))


def value_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, before, total): each distinct value of each group, null excepted, with its rows, the group's
    rows of smaller values, and the group's rows with a value. Null keys make groups of their own."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    # staged: range bounds are drawn from a sample, and both uses below must see the same ranges
    dealt = stage(counts.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "ranks")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("n").alias("_in_range"))  # at most groups + ranges rows
    group = Window.partitionBy(*keys)
    earlier = F.sum("_in_range").over(group.orderBy("_range")) - F.col("_in_range")
    sums = sums.select(*keys, "_range", earlier.alias("_earlier"), F.sum("_in_range").over(group).alias("total"))
    running = F.sum("n").over(Window.partitionBy(*keys, "_range").orderBy(value)) - F.col("n")
    ranked = dealt.withColumn("before", running)
    ranked = null_safe_left(ranked, sums, {k: F.col(k) for k in [*keys, "_range"]})
    return ranked.select(*keys, value, "n", (F.col("before") + F.col("_earlier")).alias("before"), "total")


def melted(df: DataFrame, columns: tuple[str, ...], *kept: Column) -> DataFrame:
    """A row per row and column: ``kept``, column (its name) and value (a double; what is not a number is null)."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in columns))
    return df.select(*kept, F.explode(pairs).alias("_pair")).select("*", "_pair.*").drop("_pair")


def quantile(column: Column, point: float) -> Column:
    """Aggregate over :func:`value_ranks` rows (value, n, before, total) for which ``column`` holds: the quantile,
    linear between neighbours, null without values."""
    at = F.lit(point) * (F.col("total") - 1)
    having = lambda rank: F.max(F.when(column & (F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col("value")))
    low, high, part = having(F.floor(at)), having(F.ceil(at)), F.max(F.when(column, at - F.floor(at)))
    return F.when(low == high, low).otherwise(low + (high - low) * part)


def quantiles(df: DataFrame, columns: tuple[str, ...], points: tuple[float, ...]) -> DataFrame:
    """One row: for each column its count of values, ``{c}.n``, and its quantiles, ``{c}.q`` (an array)."""
    ranked = value_ranks(melted(df, columns), ["column"], "value")
    stats = []
    for c in columns:
        own = F.col("column") == c
        stats += [F.coalesce(F.max(F.when(own, F.col("total"))), F.lit(0)).alias(f"{c}.n"), F.array(*(quantile(own, p) for p in points)).alias(f"{c}.q")]
    return ranked.agg(*stats)
