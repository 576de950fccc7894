"""Sales panels: coverage, trends, ABC classes, growth and mix. A panel has branch, sku, period, qty, turnover_cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio_or_null
from .running import running_total

PARTIAL_DAYS = 28


def last_periods(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the last n periods that occur; periods are few, so they are ranked in one task and broadcast."""
    ranked = panel.select("period").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("period")))).filter(F.col("back") <= n)
    return panel.join(F.broadcast(ranked), "period")


def coverage(panel: DataFrame) -> DataFrame:
    return panel.agg(
        F.countDistinct("period").alias("periods"), F.countDistinct("branch").alias("branches"), F.countDistinct("sku").alias("skus"), F.count(F.lit(1)).alias("cells"),
        F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("branch_list"),
    )


def _days(panel: DataFrame) -> Column:
    """Days that a branch's month covers: by day_from and day_to where the panel has them, else all of it."""
    if {"day_from", "day_to"} <= set(panel.columns):
        return F.greatest(F.lit(1), F.max("day_to") - F.min("day_from") + 1)
    return F.max(F.dayofmonth(F.last_day("period")))


def branch_summary(panel: DataFrame, months: int = 3) -> DataFrame:
    """Of each branch over the last months: units, turnover, months with rows, distinct items, mean units a month, the
    change of the daily rate from the first half of its months to the last (the middle one counts to neither), and
    whether its latest month is a part of one."""
    recent = last_periods(panel, months)
    per = recent.groupBy("branch", "period").agg(F.sum("qty").alias("qty"), F.sum("turnover_cents").alias("turnover_cents"), _days(panel).alias("days"))
    own = Window.partitionBy("branch")  # a row a month
    per = per.withColumns({"at": F.row_number().over(own.orderBy("period")), "n": F.count(F.lit(1)).over(own)})
    half, rate = F.greatest(F.lit(1), F.floor(F.col("n") / 2)), F.col("qty") / F.col("days")
    first, last = F.avg(F.when(F.col("at") <= half, rate)), F.avg(F.when(F.col("at") > F.col("n") - half, rate))
    sums = per.groupBy("branch").agg(
        F.sum("qty").alias("qty"), F.sum("turnover_cents").alias("turnover_cents"), F.count(F.lit(1)).alias("months"), F.bround(F.avg("qty"), 1).alias("avg_monthly_qty"),
        first.alias("a"), last.alias("b"), (F.max_by("days", "period") < PARTIAL_DAYS).alias("latest_month_partial"),
    )
    items = recent.groupBy("branch").agg(F.countDistinct("sku").alias("distinct_skus"))
    change = F.when(F.col("a") != 0, F.bround((F.col("b") - F.col("a")) / F.col("a") * 100, 1))
    return sums.join(items, "branch").select("branch", "qty", "turnover_cents", "months", "distinct_skus", "avg_monthly_qty", change.alias("trend_pct"), "latest_month_partial")


def trend(panel: DataFrame, months: int = 6) -> DataFrame:
    sums = last_periods(panel, months).groupBy("period").agg(F.sum("qty").alias("qty"), F.sum("turnover_cents").alias("turnover_cents"))
    return sums.withColumn("partial", F.dayofmonth(F.last_day("period")) < PARTIAL_DAYS)


def _class(share: Column) -> Column:
    return F.when(share <= 0.8, "A").when(share <= 0.95, "B").otherwise("C")


def abc(values: DataFrame, key: str, value: str, digits: int | None = None) -> DataFrame:
    """ABC classes by running share of value, largest first, ties by key; the row that crosses a cut is in the next class.
    With digits the share is rounded before the cut. Rows without a positive value are left out."""
    positive = values.filter(F.col(value) > 0)
    total = positive.agg(F.sum(value).alias("__all"))
    ran = running_total(positive, value, key, "__run").join(F.broadcast(total))
    share = F.col("__run") / F.col("__all")
    share = F.bround(share, digits) if digits is not None else share
    return ran.select(key, value, F.bround(F.col(value) * 100.0 / F.col("__all"), 3).alias("pct"), F.bround(share * 100, 1).alias("cum_pct"), _class(share).alias("abc"))


def abc_summary(classes: DataFrame, value: str) -> DataFrame:
    return classes.groupBy("abc").agg(F.count(F.lit(1)).alias("items"), F.sum(value).alias(value))


def flow_summary(panel: DataFrame) -> DataFrame:
    """The last period against the one before; and over all periods the margin, and the branch and the item of most units
    and the item of most profit with their shares (ties by name). panel may have profit_cents; without it, or without a
    positive turnover, the margin is null."""
    panel = panel if "profit_cents" in panel.columns else panel.withColumn("profit_cents", F.lit(None).cast("long"))
    now, before = F.col("back") == 1, F.col("back") == 2
    head = last_periods(panel, 2).agg(F.max("period").alias("period"), *(F.sum(F.when(w, F.col(c))).alias(f"{c}_{n}") for c in ("qty", "turnover_cents") for w, n in ((now, "now"), (before, "before"))))
    whole = panel.agg(F.countDistinct("period").alias("periods"), ratio_or_null(F.coalesce(F.sum("profit_cents"), F.lit(0)) * 100.0, F.sum("turnover_cents"), 1).alias("margin"))
    known = panel.agg(F.count("profit_cents").alias("profits"))

    def leader(column: str, value: str, name: str) -> DataFrame:
        sums = panel.groupBy(column).agg(F.sum(value).alias("q")).filter("q is not null")
        share = F.bround(F.max("q") * 100.0 / F.when(F.sum("q") == 0, 1).otherwise(F.sum("q")), 1)
        return sums.agg(F.min_by(column, F.struct(-F.col("q"), F.col(column))).alias(name), share.alias(f"{name}_pct"), F.max("q").alias(f"{name}_{value}"))

    change = lambda c: ratio_or_null((F.col(f"{c}_now") - F.col(f"{c}_before")) * 100.0, F.col(f"{c}_before"), 1)
    joined = head
    for row in (whole, known, leader("branch", "qty", "top_branch"), leader("sku", "qty", "top_sku"), leader("sku", "profit_cents", "top_profit_sku")):
        joined = joined.join(F.broadcast(row))  # one row each
    return joined.select(
        "period", "periods", "qty_now", "qty_before", "turnover_cents_now", "turnover_cents_before", change("qty").alias("qty_pct"), change("turnover_cents").alias("turnover_pct"), F.when(F.col("profits") > 0, F.col("margin")).alias("margin_pct"),
        "top_branch", "top_branch_pct", "top_sku", "top_sku_qty", "top_sku_pct", "top_profit_sku", "top_profit_sku_profit_cents", "top_profit_sku_pct",
    )


def growth(panel: DataFrame, periods: int = 12) -> DataFrame:
    """Units, change and active branches and items of each of the last periods, and second half against first half."""
    sums = last_periods(panel, periods).groupBy("period", "back").agg(F.sum("qty").alias("qty"), F.countDistinct(F.when(F.col("qty") > 0, F.col("branch"))).alias("active_branches"), F.countDistinct(F.when(F.col("qty") > 0, F.col("sku"))).alias("active_skus"))
    before = F.lag("qty").over(Window.orderBy("period"))  # a row for each period
    every = Window.partitionBy()
    first, second = F.sum(F.when(F.col("back") > periods // 2, F.col("qty"))).over(every), F.sum(F.when(F.col("back") <= periods // 2, F.col("qty"))).over(every)
    return sums.select("period", "qty", "active_branches", "active_skus", ratio_or_null((F.col("qty") - before) * 100.0, before, 1).alias("change_pct"), ratio_or_null((second - first) * 100.0, first, 1).alias("growth_pct"))


def series(panel: DataFrame, branch: str | None = None, query: str = "", by_branch: bool = True) -> DataFrame:
    """Units and turnover on every month between the first and the last, for items whose name contains the query."""
    picked = panel.filter(F.col("branch") == branch) if branch else panel
    picked = picked.filter(F.contains(F.lower("sku"), F.lit(query.lower()))) if query else picked
    keys = ["branch"] * by_branch
    calendar = panel.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("period"))
    grid = picked.select("branch").distinct().join(F.broadcast(calendar)) if by_branch else calendar
    sums = picked.groupBy(*keys, "period").agg(F.sum("qty").alias("qty"), F.sum("turnover_cents").alias("turnover_cents"))
    return grid.join(sums, [*keys, "period"], "left").na.fill(0, ["qty", "turnover_cents"])


def mix(panel: DataFrame, key: str = "sku", top: int = 8, months: int = 12) -> DataFrame:
    """Shares of the top items and of all others together; only series with a positive total in the window count."""
    totals = last_periods(panel, months).groupBy("branch", "sku").agg(F.sum("qty").alias("qty")).filter("qty > 0").groupBy(key).agg(F.sum("qty").alias("qty"))
    best = totals.orderBy(F.desc("qty"), key).limit(top).withColumn("place", F.row_number().over(Window.orderBy(F.desc("qty"), key)))
    ranked = totals.join(F.broadcast(best.select(key, "place")), key, "left")
    label = F.coalesce(F.when(F.col("place").isNotNull(), F.col(key)), F.lit("Other"))
    grouped = ranked.groupBy(label.alias("label"), F.coalesce("place", F.lit(top + 1)).alias("place")).agg(F.sum("qty").alias("qty"))
    return grouped.select("place", "label", "qty", F.bround(F.col("qty") * 100.0 / F.sum("qty").over(Window.partitionBy()), 1).alias("pct"))  # top + 1 rows
