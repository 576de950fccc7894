"""Planning views over weekly rates: worst performers, low stock, reorder points, excess stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming import jobs
from .running import average_rank

LOW_COVER_WEEKS, EXCESS_COVER_WEEKS, SAFETY_WEEKS, LEAD_WEEKS = 1.5, 12, 1.2, 2
MONTH_WEEKS = 4


def weekly_rates(lines: DataFrame, as_of: Column, weeks: int = 26) -> DataFrame:
    """Requested units a week over the last weeks for each branch and product, whole recent sales, weeks with sales."""
    recent = lines.filter((F.col("doc_date") > F.date_sub(as_of, weeks * 7)) & (F.col("doc_date") <= as_of))
    last = F.when(F.col("doc_date") > F.date_sub(as_of, MONTH_WEEKS * 7), F.col("sent_qty"))
    return recent.groupBy("branch_id", "product_id").agg(
        (F.sum("requested_qty") / weeks).alias("rate"), F.coalesce(F.sum(last), F.lit(0).cast("long")).alias("recent_sales"),
        F.countDistinct(F.date_trunc("week", "doc_date")).alias("weeks_sold"), F.sum("revenue_cents").alias("revenue_cents"), F.sum("requested_qty").alias("units"),
    )


def demand_estimate(rates: DataFrame, lines: DataFrame, as_of: Column) -> DataFrame:
    """The modelled rate; for branches without any, the last 30 days divided by four."""
    month = lines.filter((F.col("doc_date") > F.date_sub(as_of, 30)) & (F.col("doc_date") <= as_of))
    other = month.join(F.broadcast(rates.select("branch_id").distinct()), "branch_id", "left_anti").groupBy("branch_id", "product_id").agg((F.sum("requested_qty") / MONTH_WEEKS).alias("rate"))
    return rates.select("branch_id", "product_id", "rate", F.lit("model").alias("basis")).unionByName(other.withColumn("basis", F.lit("last month")))


def low_stock(rates: DataFrame, stock: DataFrame, limit: int = 50) -> DataFrame:
    """Products with a network rate in the top quarter that cover under one and a half weeks in a branch, the busiest first;
    with how many there are in all, and how many products are in that quarter. Products without a stock row have none."""
    # sums and quantile are rounded, so that ties with the quantile do not hang on the order of addition
    network = rates.groupBy("product_id").agg(F.bround(F.sum("rate"), 8).alias("network")).filter("network > 0")
    least = network.agg(F.bround(F.percentile("network", 0.75), 8).alias("least"))
    busy = network.join(F.broadcast(least)).filter("network >= least").select("product_id")
    met = rates.join(busy, "product_id").join(stock.select("branch_id", "product_id", "on_hand"), ["branch_id", "product_id"], "left").na.fill(0, ["on_hand"])
    cover = F.col("on_hand") / F.col("rate")
    low = met.filter((F.col("rate") > 0) & (cover < LOW_COVER_WEEKS)).select("branch_id", "product_id", "on_hand", F.bround("rate", 4).alias("rate"), F.bround(F.bround(cover, 8), 2).alias("cover_weeks"))
    counts = low.agg(F.count(F.lit(1)).alias("total_alerts")).join(F.broadcast(busy.agg(F.count(F.lit(1)).alias("priority_products"))))  # one row each
    return low.orderBy(F.desc("rate"), "branch_id", "product_id").limit(limit).join(F.broadcast(counts))


def reorder_points(rates: DataFrame, stock: DataFrame) -> DataFrame:
    """Safety stock, reorder point and status; the status compares stock with the unrounded point."""
    met = rates.filter("rate > 0").join(stock.select("branch_id", "product_id", "on_hand"), ["branch_id", "product_id"], "left").na.fill(0, ["on_hand"])
    safety = F.col("rate") * SAFETY_WEEKS
    point = safety + F.col("rate") * LEAD_WEEKS
    status = F.when(F.col("on_hand") <= 0, "out").when(F.col("on_hand") < point, "reorder").otherwise("ok")
    return met.select("branch_id", "product_id", "on_hand", F.bround(safety, 0).cast("long").alias("safety_stock"), F.bround(point, 0).cast("long").alias("reorder_point"), F.bround(F.bround(F.col("on_hand") / (F.col("rate") / 7), 8), 1).alias("days_left"), status.alias("status"))


def first_to_reorder(points: DataFrame, limit: int = 300) -> DataFrame:
    """The rows of reorder_points in the order in which to act: what is at or below its point first, of these and of the
    others what runs out soonest, unknown last; with the number of all rows and of those to reorder."""
    due = F.col("status") != "ok"
    counts = points.agg(F.count(F.lit(1)).alias("products"), F.count_if(due).alias("to_reorder"))
    order = [F.desc(due), F.asc_nulls_last("days_left"), F.asc("branch_id"), F.asc("product_id")]
    place = F.row_number().over(Window.orderBy(*order))  # `limit` rows
    return points.orderBy(*order).limit(limit).withColumn("place", place).join(F.broadcast(counts))


def excess_stock(rates: DataFrame, stock: DataFrame) -> DataFrame:
    """Stock of over twelve weeks of cover, rounded to one digit before the test, or of no rate at all."""
    met = stock.filter("on_hand > 0").join(rates.select("branch_id", "product_id", "rate"), ["branch_id", "product_id"], "left")
    cover = F.bround(F.bround(F.col("on_hand") / F.col("rate"), 8), 1)
    dead = F.coalesce(F.col("rate") <= 0, F.lit(True))
    return met.filter(dead | (cover > EXCESS_COVER_WEEKS)).select("branch_id", "product_id", "on_hand", F.when(~dead, cover).alias("cover_weeks"), dead.alias("dead"))


def percent_rank_avg(value: Column, by: str) -> Column:
    """Rank in the group as a fraction, ties sharing the mean of their ranks."""
    group = Window.partitionBy(by)
    ties = F.count(F.lit(1)).over(Window.partitionBy(by, value))
    return (F.rank().over(group.orderBy(value)) + (ties - 1) / 2) / F.count(F.lit(1)).over(group)


def worst_performers(rates: DataFrame, stock: DataFrame, limit: int = 15) -> DataFrame:
    """Of each branch's products in stock those with the least sum of percent ranks by units and by revenue."""
    held = stock.filter("on_hand > 0").select("branch_id", "product_id", "on_hand").join(rates.select("branch_id", "product_id", "units", "revenue_cents", "rate"), ["branch_id", "product_id"], "left").na.fill(0, ["units", "revenue_cents"])
    score = percent_rank_avg(F.col("units"), "branch_id") + percent_rank_avg(F.col("revenue_cents"), "branch_id")
    scored = held.withColumn("score", F.bround(score, 6)).withColumn("place", F.row_number().over(Window.partitionBy("branch_id").orderBy("score", "product_id")))
    return scored.filter(F.col("place") <= limit).select("branch_id", "place", "product_id", "on_hand", "units", "revenue_cents", "score")


def worst_of_network(rates: DataFrame, stock: DataFrame, weeks: int = 26, limit: int = 15, branch_ids: list[int] | None = None) -> DataFrame:
    """The two lists of dead and slow stock, of products over the network (`overall`) and of products in branches
    (`branch`): of what is in stock the least sum of average-tie percent ranks by units and by revenue, of equal ones the
    larger stock. Shares are of all units and of all positive revenue in scope, cover is in weeks, null without a rate.
    branch_ids restricts both lists. rates: branch_id, product_id, units, revenue_cents; stock: branch_id, product_id, on_hand."""
    if branch_ids:
        rates, stock = (df.filter(F.col("branch_id").isin(branch_ids)) for df in (rates, stock))
    held = stock.groupBy("branch_id", "product_id").agg(F.sum("on_hand").alias("on_hand"))
    known = held.join(rates.select("branch_id", "product_id", "units", "revenue_cents"), ["branch_id", "product_id"], "full").na.fill(0, ["on_hand", "units", "revenue_cents"])
    known = jobs.kept(known, "known")  # each list reads it several times
    products = known.groupBy("product_id").agg(*(F.sum(c).alias(c) for c in ("on_hand", "units", "revenue_cents")))
    products = jobs.kept(products, "products")
    totals = products.agg(F.sum("units").alias("__u"), F.sum(F.greatest("revenue_cents", F.lit(0))).alias("__r"))

    def listed(rows: DataFrame, scope: str) -> DataFrame:
        rows = rows.filter("on_hand > 0")
        ranked = average_rank(average_rank(rows, "units", "__by_units"), "revenue_cents", "__by_revenue")
        n = rows.agg(F.count(F.lit(1)).alias("__n"))
        order = [F.asc("__score"), F.desc("on_hand"), F.asc("branch_id"), F.asc("product_id")]
        worst = ranked.withColumn("__score", F.col("__by_units") + F.col("__by_revenue")).orderBy(*order).limit(limit)
        place = F.row_number().over(Window.orderBy(*order)).alias("place")  # `limit` rows
        share = lambda c, t: F.coalesce(F.bround(100 * F.greatest(F.col(c), F.lit(0)) / F.col(t), 4), F.lit(0.0))
        return worst.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(n)).select(  # one row each
            F.lit(scope).alias("scope"), place, "branch_id", "product_id", "on_hand", "units", "revenue_cents", share("units", "__u").alias("units_pct"), share("revenue_cents", "__r").alias("revenue_pct"),
            F.when(F.col("units") > 0, F.bround(F.bround(F.col("on_hand") / (F.col("units") / weeks), 8), 1)).alias("cover_weeks"), (F.col("units") == 0).alias("dead"), F.bround(F.col("__score") / (2 * F.col("__n")), 6).alias("score"),
        )

    overall = products.withColumn("branch_id", F.lit(None).cast(dict(known.dtypes)["branch_id"]))
    return listed(overall, "overall").unionByName(listed(known, "branch"))


def transport_plan(rates: DataFrame, stock: DataFrame, days: int = 10) -> DataFrame:
    """What each branch lacks of so many days of its larger rate, modelled or recent."""
    demand = F.greatest(F.col("rate"), F.col("recent_sales") / MONTH_WEEKS)
    target = F.ceil(F.bround(demand * days / 7, 6))
    met = rates.join(stock.select("branch_id", "product_id", "on_hand"), ["branch_id", "product_id"], "left").na.fill(0, ["on_hand"])
    short = F.greatest(F.lit(0).cast("long"), target - F.col("on_hand"))
    return met.select("branch_id", "product_id", "on_hand", F.bround(demand, 4).alias("demand"), target.alias("target"), short.alias("to_transport")).filter("to_transport > 0")
