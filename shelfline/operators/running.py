"""Running totals over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_HOT = 2000


def running_total(df: DataFrame, value: str, key: str, total: str, pieces: int = 64) -> DataFrame:
    """Adds `total`: the sum of value from the largest down to each row, ties by key.

    Rows are cut into up to `pieces` ranges of value at approximate quantiles (any bounds give the same totals); a
    window runs inside each range, and the ranges' own sums, a row each, are carried in front."""
    bounds = df.agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 1000).alias("b")).collect()[0].b or []
    at = sum((F.when(F.col(value) < b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0))
    ranged = df.withColumn("__range", at)
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__range", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("__range").orderBy(F.desc(value), key).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(sums), "__range").withColumn(total, F.col("__ahead") + F.sum(value).over(inside)).drop("__range", "__ahead")


def average_rank(df: DataFrame, value: str, twice: str, pieces: int = 64) -> DataFrame:
    """Adds twice the rank of value among all rows, from the smallest on, ties sharing the mean of their ranks: a whole
    number. Rows are counted by value first; the values are cut into ranges at approximate quantiles and numbered inside
    each, and the ranges' counts are carried in front. Nulls rank first. The ranks of values that more than one in MOST_HOT
    rows have, fewer than MOST_HOT by that, are broadcast, so that their rows don't meet in one task."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__k"))
    known = counts.agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)], 1000).alias("b"), F.sum("__k").alias("n")).first()
    bounds = known.b or []
    ranged = counts.withColumn("__range", sum((F.when(F.col(value) > b, 1).otherwise(0) for b in sorted(set(bounds))), F.lit(0)))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = ranged.groupBy("__range").agg(F.sum("__k").alias("__sum")).select("__range", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("__range").orderBy(F.col(value).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__ahead") + F.coalesce(F.sum("__k").over(inside), F.lit(0))
    ranks = ranged.join(F.broadcast(sums), "__range").select(F.col(value).alias("__value"), "__k", (2 * before + F.col("__k") + 1).alias("__rank"))
    hot = F.col("__k") > max(1, (known.n or 0) // MOST_HOT)
    often = ranks.filter(hot).select(F.col("__value").alias("__often"), F.col("__rank").alias("__often_rank"))
    rare = ranks.filter(~hot).select("__value", F.col("__rank").alias(twice))
    same = F.col(value).eqNullSafe(F.col("__often"))
    at_once = df.join(F.broadcast(often), same).drop("__often").withColumnRenamed("__often_rank", twice)
    dealt = df.join(F.broadcast(often.select("__often")), same, "left_anti").join(rare, F.col(value).eqNullSafe(F.col("__value"))).drop("__value")
    return at_once.unionByName(dealt)
