"""Back-order flow: fulfilment, stages, ageing, trend and product verdicts. Frames come from sources.tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import AGE_BUCKETS, age_bucket, ratio, ratio_or_null, week_ending_sunday

#: Fixed values of the verdicts: scarce below and above, back orders that make it chronic, filled well, few sold.
LOW_FILL, HIGH_UNMET, HIGH_STOCKOUT, CHRONIC, GOOD_FILL, FEW_SOLD = 0.6, 0.4, 0.3, 3, 0.9, 5


def _zero() -> Column:
    return F.lit(0).cast("long")


def metrics(orders: DataFrame, items: DataFrame) -> DataFrame:
    """One row of key figures."""
    open_, closed = F.col("status") == "OPEN", F.col("status") == "CLOSED"
    head = orders.agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(open_).alias("open_orders"), F.count_if(closed).alias("closed_orders"), F.count_if("is_overdue").alias("overdue_orders"),
        F.coalesce(F.sum("qty_ordered"), _zero()).alias("qty_ordered"), F.coalesce(F.sum("qty_fulfilled"), _zero()).alias("qty_fulfilled"),
        F.sum(F.when(closed, F.col("lead_time_days"))).alias("lead_sum"), F.median(F.when(closed, F.col("lead_time_days"))).alias("median_lead_days"),
        F.count_if(closed & (F.col("lead_time_days") <= F.col("sla_days"))).alias("on_time"),
    )
    line = items.agg(F.count(F.lit(1)).alias("items"), *(F.count_if(F.col("fill_status") == s).alias(f"{s.lower()}_items") for s in ("FULL", "PARTIAL", "NIL")), F.coalesce(F.sum("outstanding_qty"), _zero()).alias("outstanding_qty"), F.coalesce(F.sum("value_outstanding_cents"), _zero()).alias("value_outstanding_cents"))
    return head.join(F.broadcast(line)).select(  # one row each
        "orders", "open_orders", "closed_orders", "overdue_orders", "items", "full_items", "partial_items", "nil_items", "qty_ordered", "qty_fulfilled", "outstanding_qty", "value_outstanding_cents",
        ratio(F.col("qty_fulfilled"), F.col("qty_ordered"), 4).alias("fulfilment_rate"), ratio_or_null(F.col("lead_sum"), F.col("closed_orders"), 2).alias("mean_lead_days"), "median_lead_days",
        ratio(F.col("on_time"), F.col("closed_orders"), 4).alias("on_time_rate"),
    )


def stage_funnel(orders: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Counts of the given stages in their order, zeros kept."""
    counts = orders.groupBy("stage").agg(F.count(F.lit(1)).alias("orders"), F.sum("outstanding_qty").alias("outstanding_qty"))
    every = orders.sparkSession.createDataFrame(list(enumerate(stages)), "ord int, stage string")
    return F.broadcast(every).join(counts, "stage", "left").select("ord", "stage", F.coalesce("orders", _zero()).alias("orders"), F.coalesce("outstanding_qty", _zero()).alias("outstanding_qty"))


def stage_durations(events: DataFrame) -> DataFrame:
    """Microseconds spent in each stage until the next event of the same order; the last event has none."""
    following = F.lead("at_us").over(Window.partitionBy("bo_no").orderBy("at_us", "event_id"))
    return events.withColumn("next_us", following).filter("next_us is not null").withColumn("micros", F.col("next_us") - F.col("at_us"))


def cycle_times(events: DataFrame) -> DataFrame:
    """Transitions, mean, median and 90th percentile (interpolated) of the days in each stage."""
    days = F.col("micros") / 86_400_000_000
    return stage_durations(events).groupBy("to_stage").agg(
        F.count(F.lit(1)).alias("transitions"), F.bround(F.sum("micros") / F.count(F.lit(1)) / 86_400_000_000, 2).alias("mean_days"),
        F.bround(F.percentile(days, 0.5), 2).alias("median_days"), F.bround(F.percentile(days, 0.9), 2).alias("p90_days"),
    )


def bottleneck(events: DataFrame) -> DataFrame:
    """The stage with the largest rounded mean; of equal ones the first by name."""
    return cycle_times(events).orderBy(F.desc("mean_days"), "to_stage").limit(1).select("to_stage", "mean_days")


def ageing(orders: DataFrame) -> DataFrame:
    """Open orders by age, a null age as 0, empty buckets kept."""
    counts = orders.filter("status = 'OPEN'").groupBy(age_bucket(F.coalesce("age_days", F.lit(0))).alias("bucket")).agg(F.count(F.lit(1)).alias("orders"), F.sum("outstanding_qty").alias("outstanding_qty"))
    every = orders.sparkSession.createDataFrame([(b,) for b in AGE_BUCKETS], "bucket string")
    return F.broadcast(every).join(counts, "bucket", "left").select("bucket", F.coalesce("orders", _zero()).alias("orders"), F.coalesce("outstanding_qty", _zero()).alias("outstanding_qty"))


def ageing_by_group(orders: DataFrame, group: str) -> DataFrame:
    """Group by age bucket, counts as columns."""
    names = dict(zip(AGE_BUCKETS, ("d0_7", "d8_14", "d15_30", "d30_plus")))
    counts = orders.groupBy(group).pivot("bucket", list(AGE_BUCKETS)) if "bucket" in orders.columns else orders.withColumn("bucket", age_bucket(F.coalesce("age_days", F.lit(0)))).groupBy(group).pivot("bucket", list(AGE_BUCKETS))
    return counts.agg(F.count(F.lit(1))).na.fill(0).withColumnsRenamed(names)


def by_branch(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Per branch; a branch without closed orders has mean lead time 0."""
    heads = orders.groupBy("branch_id", "branch").agg(
        F.count(F.lit(1)).alias("orders"), F.count_if(F.col("status") == "OPEN").alias("open_orders"), F.count_if("is_overdue").alias("overdue_orders"),
        F.coalesce(F.bround(F.sum("lead_time_days") / F.count("lead_time_days"), 1), F.lit(0.0)).alias("mean_lead_days"),
    )
    lines = items.groupBy("branch_id").agg(F.sum("qty_ordered").alias("qty_ordered"), F.sum("qty_fulfilled").alias("qty_fulfilled"), F.sum("outstanding_qty").alias("outstanding_qty"))
    return heads.join(lines, "branch_id", "left").na.fill(0, ["qty_ordered", "qty_fulfilled", "outstanding_qty"]).withColumn("fulfilment_rate", ratio(F.col("qty_fulfilled"), F.col("qty_ordered"), 4))


def top_items(items: DataFrame, top: int = 20) -> DataFrame:
    sums = items.filter("description is not null").groupBy("product_id", "description").agg(F.countDistinct("bo_no").alias("orders"), F.sum("qty_ordered").alias("qty_ordered"), F.sum("outstanding_qty").alias("outstanding_qty"), F.sum("value_outstanding_cents").alias("value_outstanding_cents"))
    return sums.orderBy(F.desc("outstanding_qty"), "product_id").limit(top)


def orders_against_sales(lines: DataFrame, items: DataFrame, as_of: Column, weeks: int = 13) -> DataFrame:
    """Weekly sales and back-order rates per branch over the last weeks; branches of either side."""
    since = F.date_sub(as_of, weeks * 7)
    sales = lines.filter(F.col("doc_date") >= since).groupBy("branch_id").agg(F.sum("sent_qty").alias("sold"))
    short = items.filter(F.col("doc_date") >= since).groupBy("branch_id").agg(F.sum("qty_ordered").alias("short"))
    both = sales.join(short, "branch_id", "full").na.fill(0, ["sold", "short"])
    return both.select(
        "branch_id", "sold", "short", F.bround(F.col("sold") / weeks, 2).alias("sold_per_week"), F.bround(F.col("short") / weeks, 2).alias("short_per_week"),
        ratio_or_null(F.col("sold"), F.col("sold") + F.col("short"), 3).alias("demand_met"), ratio_or_null(F.col("short"), F.col("sold"), 3).alias("short_to_sales"),
    )


def weekly_flow(orders: DataFrame) -> DataFrame:
    """Orders raised and closed in each week (ending Sunday) from the first to the last, and what is outstanding."""
    raised = orders.groupBy(week_ending_sunday(F.col("submitted_at")).alias("week")).agg(F.count(F.lit(1)).alias("raised"))
    closed = orders.filter("closed_at is not null").groupBy(week_ending_sunday(F.col("closed_at")).alias("week")).agg(F.count(F.lit(1)).alias("closed"))
    both = raised.join(closed, "week", "full")
    calendar = both.agg(F.min("week").alias("lo"), F.max("week").alias("hi")).select(F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias("week"))
    filled = calendar.join(both, "week", "left").na.fill(0, ["raised", "closed"])
    # one row a week, so the unpartitioned window stays small
    return filled.withColumn("outstanding", F.sum(F.col("raised") - F.col("closed")).over(Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)))


def daily_average(lines: DataFrame, days: int = 7) -> DataFrame:
    """Units sent each day and their moving average over that and the rows before."""
    daily = lines.groupBy("doc_date").agg(F.sum("sent_qty").alias("sent_qty"))
    window = Window.orderBy("doc_date").rowsBetween(-(days - 1), 0)  # one row a day
    return daily.withColumn("moving_average", F.bround(F.sum("sent_qty").over(window) / F.count(F.lit(1)).over(window), 4))


def lead_histogram(orders: DataFrame, most: int = 20) -> DataFrame:
    """Lead times in min(most, n) equal bins between the least and the largest."""
    lead = orders.filter("lead_time_days is not null").select("lead_time_days")
    span = lead.agg(F.min("lead_time_days").alias("lo"), F.max("lead_time_days").alias("hi"), F.least(F.count(F.lit(1)), F.lit(most)).alias("bins"))
    at = F.least(F.floor((F.col("lead_time_days") - F.col("lo")) * F.col("bins") / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))), F.col("bins") - 1)
    return lead.join(F.broadcast(span)).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("orders"), F.min("lead_time_days").alias("least_days"), F.max("lead_time_days").alias("most_days"))


def branch_item_heatmap(items: DataFrame, branches: tuple[int, ...], top: int = 20) -> DataFrame:
    """Outstanding units of the top items, a column for each branch."""
    best = items.groupBy("product_id").agg(F.sum("outstanding_qty").alias("total")).orderBy(F.desc("total"), "product_id").limit(top)
    cells = items.join(F.broadcast(best.select("product_id")), "product_id", "left_semi").groupBy("product_id").pivot("branch_id", list(branches)).agg(F.sum("outstanding_qty")).na.fill(0)
    return cells.withColumnsRenamed({str(b): f"b{b}" for b in branches})


def last_months(rows: DataFrame, day: str, n: int) -> DataFrame:
    """The rows of the last n months that have any; the months are a row each."""
    month = F.trunc(day, "month")
    known = rows.select(month.alias("__month")).distinct().orderBy(F.desc("__month")).limit(n)
    return rows.join(F.broadcast(known), month == F.col("__month"), "left_semi")


def product_performance(lines: DataFrame, items: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Of each product: sales of the last days // 30 months on record, requests and fill of the last days, all its back
    orders, and a verdict that tells products that could not be had from those that nobody asked for. Sorted by the
    value of lost sales, then by unmet demand and sales value."""
    sales = last_months(lines, "doc_date", max(1, days // 30)).groupBy("product_id").agg(F.sum("sent_qty").alias("sold_qty"), F.sum(F.col("sent_qty") * F.col("price_cents")).alias("sold_cents"))
    nil = F.count_if(F.col("fill_status") == "NIL")
    asked = lines.filter(F.col("doc_date") >= F.date_sub(as_of, days)).groupBy("product_id").agg(F.sum("requested_qty").alias("requested_qty"), F.sum("sent_qty").alias("sent_qty"), F.count(F.lit(1)).alias("lines"), nil.alias("nil_lines"), F.max("description").alias("description"), F.max("category").alias("category"))
    short = items.groupBy("product_id").agg(
        F.countDistinct("bo_no").alias("bo_incidents"), F.sum("qty_ordered").alias("bo_qty"), F.sum("qty_fulfilled").alias("bo_fulfilled"), F.sum("outstanding_qty").alias("bo_outstanding_qty"),
        F.sum("value_outstanding_cents").alias("lost_sales_cents"), F.sum("lead_time_days").alias("lead_sum"), F.count("lead_time_days").alias("leads"),
    )
    counts = ["sold_qty", "sold_cents", "requested_qty", "sent_qty", "lines", "nil_lines", "bo_incidents", "bo_qty", "bo_fulfilled", "bo_outstanding_qty", "lost_sales_cents"]
    all_ = asked.join(sales, "product_id", "full").join(short, "product_id", "full").na.fill(0, counts)
    c = F.col
    unmet = F.greatest(c("requested_qty") - c("sent_qty"), _zero())
    rated = all_.withColumns({
        "fill_rate": ratio_or_null(c("sent_qty"), c("requested_qty"), 3), "unmet_demand_ratio": ratio_or_null(unmet, c("requested_qty"), 3), "stockout_line_pct": ratio_or_null(c("nil_lines"), c("lines"), 3),
        "recovery_rate": ratio_or_null(c("bo_fulfilled"), c("bo_qty"), 3), "avg_wait_days": ratio_or_null(c("lead_sum"), c("leads"), 1), "demand_captured_pct": ratio_or_null(c("sold_qty"), c("sold_qty") + c("bo_qty"), 3),
    })
    scarce = F.coalesce((c("fill_rate") < LOW_FILL) | (c("unmet_demand_ratio") > HIGH_UNMET) | (c("stockout_line_pct") > HIGH_STOCKOUT), F.lit(False))
    unwanted = F.coalesce(c("fill_rate") >= GOOD_FILL, F.lit(True)) & (c("bo_incidents") == 0) & (c("sold_qty") <= FEW_SOLD)
    verdict = (
        F.when((c("requested_qty") == 0) & (c("bo_incidents") == 0), "No demand signal")
        .when(scarce & (c("bo_incidents") >= CHRONIC), "Chronic shortage").when(scarce, "Supply-constrained")
        .when(unwanted, "Genuinely low demand").otherwise("Healthy")
    )
    named = rated.withColumn("description", F.coalesce("description", F.col("product_id").cast("string"))).withColumn("verdict", verdict)
    shown = ["product_id", "description", "category", *counts[:4], "fill_rate", "unmet_demand_ratio", "stockout_line_pct", "bo_incidents", "bo_qty", "bo_outstanding_qty", "recovery_rate", "avg_wait_days", "demand_captured_pct", "lost_sales_cents", "verdict"]
    return named.select(*shown).orderBy(F.desc("lost_sales_cents"), F.desc_nulls_last("unmet_demand_ratio"), F.desc("sold_cents"), "product_id")


def performance_kpis(performance: DataFrame) -> DataFrame:
    """One row: products, how many have each verdict that calls for something, lost sales and the median fill rate."""
    has = lambda verdict: F.count_if(F.col("verdict") == verdict)
    return performance.agg(
        F.count(F.lit(1)).alias("products"), has("Supply-constrained").alias("supply_constrained"), has("Chronic shortage").alias("chronic_shortage"), has("Genuinely low demand").alias("genuinely_low_demand"),
        F.count_if(F.coalesce("stockout_line_pct", F.lit(0.0)) > 0).alias("products_with_stockout"), F.coalesce(F.sum("lost_sales_cents"), _zero()).alias("lost_sales_cents"), F.bround(F.median("fill_rate"), 3).alias("median_fill_rate"),
    )


def low_sales(rates: DataFrame, stock: DataFrame, items: DataFrame, least: int = 3, gap: float = 0.4) -> DataFrame:
    """Series that sold under (1 - gap) of what was predicted, and why: an open back order, no stock and none, or neither,
    so that demand is low. rates has branch_id, product_id, predicted, actual. The largest shortfall comes first."""
    ordered = items.filter("status = 'OPEN'").groupBy("branch_id", "product_id").agg(F.sum(F.col("qty_ordered") - F.col("qty_fulfilled")).alias("backordered"))
    low = rates.filter((F.col("predicted") >= least) & (F.col("actual") < F.col("predicted") * (1 - gap)))
    met = low.join(ordered, ["branch_id", "product_id"], "left").join(stock.select("branch_id", "product_id", "on_hand"), ["branch_id", "product_id"], "left").na.fill(0, ["backordered", "on_hand"])
    cause = F.when(F.col("backordered") > 0, "Stockout, back ordered").when(F.col("on_hand") <= 0, "No stock, no back order").otherwise("Low demand, stock available")
    told = met.select("branch_id", "product_id", "predicted", "actual", (F.col("predicted") - F.col("actual")).alias("shortfall"), "backordered", "on_hand", cause.alias("cause"))
    return told.orderBy(F.desc("shortfall"), F.desc("backordered"), "branch_id", "product_id")
