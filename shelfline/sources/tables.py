"""Adapters: the star-schema tables as delivery notes, back orders, stage events, sales panels and stock levels.

A branch is a nation, a product a part, a delivery note an order; a line's return flag tells how much was sent. Money is
kept in whole cents, so that sums don't depend on their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Today" of every query over these tables.
AS_OF = "2001-08-31"
SLA_DAYS = 14
ROWS_A_TASK = 200_000


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def tasks(df: DataFrame) -> int:
    """Tasks of up to ROWS_A_TASK rows for a table; its rows are counted in the files' footers."""
    return -(-df.count() // ROWS_A_TASK)


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """df by its keys in n tasks, where that is more than the session's shuffles have, so that a task's rows don't grow
    with the table."""
    return df.repartition(n, *keys) if n and n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch and region of each nation: 25 rows, whatever the scale."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("branch_id"), F.col("n_name").alias("branch"), F.col("r_name").alias("region"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery notes: date, status and branch of each order. Orders meet customers before any line moves."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("order_status"), F.col("o_orderdate").cast("date").alias("doc_date"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("branch_id"))
    placed = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(branches(spark, sf_dir)), "branch_id")
    return placed.select(F.col("o_orderkey").alias("dn_no"), "doc_date", "order_status", "branch_id", "branch", "region")


def delivery_lines(spark: SparkSession, sf_dir: str, product: bool = True) -> DataFrame:
    """Delivery-note lines with what was requested and sent, the shortfall, its value and age. With product=False the
    columns of the product and the values by its price are left out, and lines are shuffled once, by their note."""
    line = table(spark, sf_dir, "lineitem")
    n = tasks(line)
    requested = F.col("l_quantity").cast("long")
    sent = F.when(F.col("l_returnflag") == "N", requested).when(F.col("l_returnflag") == "A", F.floor(F.col("l_quantity") / 2)).otherwise(F.lit(0).cast("long"))
    lines = dealt(line.select(
        F.col("l_orderkey").alias("dn_no"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("product_id"), requested.alias("requested_qty"), sent.alias("sent_qty"),
        F.col("l_linestatus").alias("line_status"), cents("l_extendedprice").alias("revenue_cents"),
    ), n, "dn_no").join(dealt(notes(spark, sf_dir), n, "dn_no"), "dn_no")
    short = F.greatest(F.col("requested_qty") - F.col("sent_qty"), F.lit(0).cast("long"))
    status = F.when(short == 0, "FULL").when(F.col("sent_qty") == 0, "NIL").otherwise("PARTIAL")
    lines = lines.withColumns({"backorder_qty": short, "fill_status": status, "age_days": F.datediff(as_of(), F.col("doc_date"))})
    if not product:
        return lines
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("description"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), cents("p_retailprice").alias("price_cents"))
    return lines.join(part, "product_id").withColumn("backorder_cents", F.col("backorder_qty") * F.col("price_cents"))


def back_order_items(spark: SparkSession, sf_dir: str, product: bool = True) -> DataFrame:
    """Short lines as back-order items; outstanding is never below zero. Each has its order's lead time, where closed."""
    lines = delivery_lines(spark, sf_dir, product).filter("backorder_qty > 0")
    fulfilled = F.when(F.col("line_status") == "F", F.col("backorder_qty")).otherwise(F.floor(F.col("backorder_qty") / 2))
    outstanding = F.greatest(F.col("qty_ordered") - F.col("qty_fulfilled"), F.lit(0).cast("long"))
    of_product = ["description", "category", "price_cents"] if product else []
    lead = F.when(F.col("order_status") == "F", (F.col("dn_no") % 45 + 1).cast("int"))
    items = (
        lines.select(F.col("dn_no").alias("bo_no"), "line_no", "branch_id", "branch", "product_id", *of_product, "doc_date", F.when(F.col("order_status") == "F", "CLOSED").otherwise("OPEN").alias("status"), lead.alias("lead_time_days"), F.col("backorder_qty").alias("qty_ordered"), fulfilled.alias("qty_fulfilled"))
        .withColumn("outstanding_qty", outstanding)
        .withColumn("fill_status", F.when(F.col("outstanding_qty") == 0, "FULL").when(F.col("qty_fulfilled") == 0, "NIL").otherwise("PARTIAL"))
    )
    return items.withColumn("value_outstanding_cents", F.col("outstanding_qty") * F.col("price_cents")) if product else items


def back_orders(spark: SparkSession, sf_dir: str, product: bool = True) -> DataFrame:
    """One row for each back order: sums of its items, lead time when closed, age and whether it is overdue. With
    product=False without its value."""
    value = [F.sum("value_outstanding_cents").alias("value_outstanding_cents")] if product else []
    heads = back_order_items(spark, sf_dir, product).groupBy("bo_no", "branch_id", "branch", "status", "doc_date").agg(
        F.count(F.lit(1)).alias("items"), F.sum("qty_ordered").alias("qty_ordered"), F.sum("qty_fulfilled").alias("qty_fulfilled"), *value
    )
    return (
        heads.withColumnRenamed("doc_date", "submitted_at")
        .withColumn("closed_at", F.when(F.col("status") == "CLOSED", F.date_add("submitted_at", (F.col("bo_no") % 45 + 1).cast("int"))))
        .withColumns({
            "stage": F.col("status"),
            "outstanding_qty": F.col("qty_ordered") - F.col("qty_fulfilled"),
            "age_days": F.datediff(as_of(), F.col("submitted_at")),
            "lead_time_days": F.datediff("closed_at", "submitted_at"),
            "sla_days": F.lit(SLA_DAYS),
        })
        .withColumn("is_overdue", (F.col("status") == "OPEN") & (F.col("age_days") > F.col("sla_days")))
    )


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage log: an order's number, the stage it moves to, and when (microseconds since 1970, UTC)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("bo_no"), "event_id", F.col("event_type").alias("to_stage"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))


def monthly_panel(spark: SparkSession, sf_dir: str, by: str = "region") -> DataFrame:
    """Units and turnover by branch (a region, or by='branch' a nation), brand and month."""
    lines = delivery_lines(spark, sf_dir)
    return lines.groupBy(F.col(by).alias("branch"), F.col("brand").alias("sku"), F.trunc("doc_date", "month").alias("period")).agg(F.sum("requested_qty").alias("qty"), F.sum("revenue_cents").alias("turnover_cents"))


def stock_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock on hand of each branch and product that ever met, a fixed function of the keys."""
    pairs = delivery_lines(spark, sf_dir, product=False).select("branch_id", "branch", "product_id").distinct()
    return pairs.withColumn("on_hand", (F.col("branch_id") * 31 + F.col("product_id") * 17) % 120)


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sku (a brand), item (its first product's name) and category."""
    from ..operators.files import category

    part = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("sku")).agg(F.min("p_name").alias("item"))
    return part.withColumn("category", category(F.col("item")))
