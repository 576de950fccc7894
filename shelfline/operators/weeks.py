"""Weeks that months stand in for: monthly totals laid over the weeks that no real weekly reading covers yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monday(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def open_days(months: DataFrame, real: DataFrame) -> DataFrame:
    """branch, period, week_start, days, span: of the days that a month reports (`span`), those of each week from Monday
    that no real week covers. months: branch, period, day_from, day_to; real: branch, week_start, whatever weekday that is.
    A row for each branch, month and week; weeks that are covered whole have none."""
    spans = months.groupBy("branch", "period").agg(F.greatest(F.min("day_from"), F.lit(1)).alias("first"), F.max("day_to").alias("last"))
    begin, end = F.date_add("period", F.col("first") - 1), F.least(F.date_add("period", F.col("last") - 1), F.last_day("period"))
    spans = spans.select("branch", "period", begin.alias("begin"), end.alias("end")).filter("begin <= end")
    days = spans.select("branch", "period", (F.datediff("end", "begin") + 1).alias("span"), F.explode(F.sequence("begin", "end")).alias("day"))
    covered = real.select("branch", F.explode(F.sequence("week_start", F.date_add("week_start", 6))).alias("day")).distinct()
    return days.join(covered, ["branch", "day"], "left_anti").groupBy("branch", "period", "span", monday(F.col("day")).alias("week_start")).agg(F.count(F.lit(1)).alias("days"))


def simulated_weeks(months: DataFrame, real: DataFrame) -> DataFrame:
    """branch, week_start, sku, item, qty, turnover: months (branch, period, day_from, day_to, sku, item, qty,
    turnover_cents) spread over their days at an even rate and summed over the open days of each week. A real week in the
    middle of a month leaves the rate of the days around it as it is. Weeks in which a product has nothing are left out."""
    met = months.join(open_days(months, real), ["branch", "period"])
    share = lambda value: F.sum(F.col(value) * F.col("days") / F.col("span")).alias(value)
    sums = met.groupBy("branch", "week_start", "sku").agg(
        F.min_by("item", "period").alias("item"), share("qty"), share("turnover_cents")
    )
    return sums.filter("qty > 0").select("branch", "week_start", "sku", "item", F.bround("qty", 2).alias("qty"), (F.bround("turnover_cents", 0) / 100).alias("turnover"))


def weekly_table(months: DataFrame, real: DataFrame) -> DataFrame:
    """Real weeks (branch, week_start, sku, item, qty, turnover) and the simulated ones around them, told apart by
    `simulated`."""
    return real.withColumn("simulated", F.lit(False)).unionByName(simulated_weeks(months, real).withColumn("simulated", F.lit(True)))


def touched_parts(touched: DataFrame) -> DataFrame:
    """branch, month: the months in which weeks begin that overlap the touched ones (branch, period)."""
    return touched.select("branch", F.explode(F.array("period", F.add_months("period", -1))).alias("month")).distinct()


def rebuilt_parts(months: DataFrame, real: DataFrame, parts: DataFrame) -> DataFrame:
    """weekly_table() of the weeks that begin in the given months (branch, month), from the months and real weeks that reach
    into these alone; adds `month`."""
    after = parts.select("branch", F.explode(F.array("month", F.add_months("month", 1))).alias("period")).distinct()
    around = parts.select("branch", F.explode(F.array(F.add_months("month", -1), "month", F.add_months("month", 1))).alias("__month")).distinct()
    some = months.join(after, ["branch", "period"], "left_semi")
    near = real.withColumn("__month", F.trunc("week_start", "month")).join(around, ["branch", "__month"], "left_semi").drop("__month")
    return weekly_table(some, near).withColumn("month", F.trunc("week_start", "month")).join(parts, ["branch", "month"], "left_semi")
