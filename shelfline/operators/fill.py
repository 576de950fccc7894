"""Delivery-note fill: what was requested, what was sent, what is short. Frames are sources.tables.delivery_lines()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import AGE_BUCKETS, age_bucket, money, ratio, week_ending_sunday

STATUSES = ("FULL", "PARTIAL", "NIL")


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("lines"), *(F.sum(c).alias(c) for c in ("requested_qty", "sent_qty", "backorder_qty"))]


def _short() -> Column:
    return F.count_if(F.col("backorder_qty") > 0).alias("backordered_lines")


def _nil() -> Column:
    return F.count_if(F.col("fill_status") == "NIL").alias("nil_lines")


def _literals(df: DataFrame, name: str, values: tuple[str, ...]) -> DataFrame:
    """A dimension of a few fixed values in their order."""
    return df.sparkSession.createDataFrame(list(enumerate(values)), f"ord int, {name} string")


def overall(lines: DataFrame) -> DataFrame:
    return lines.agg(
        F.countDistinct("dn_no").alias("documents"), F.countDistinct("branch_id").alias("branches"), F.countDistinct("product_id").alias("products"),
        *_sums(), _short(), *(F.count_if(F.col("fill_status") == s).alias(f"{s.lower()}_lines") for s in STATUSES), F.coalesce(F.sum("backorder_cents"), F.lit(0).cast("long")).alias("value"),
    ).withColumns({"fill_rate": ratio(F.col("sent_qty"), F.col("requested_qty"), 4), "line_fill_rate": ratio(F.col("full_lines"), F.col("lines"), 4), "value": money(F.col("value"))})


def by_status(lines: DataFrame) -> DataFrame:
    """FULL, PARTIAL and NIL, also those without lines."""
    sums = lines.groupBy("fill_status").agg(*_sums())
    every = F.broadcast(_literals(lines, "fill_status", STATUSES)).join(sums, "fill_status", "left").na.fill(0, ["lines", "requested_qty", "sent_qty", "backorder_qty"])
    total = lines.agg(F.count(F.lit(1)).alias("all_lines"))  # one row
    return every.join(F.broadcast(total)).select("fill_status", "lines", "requested_qty", "sent_qty", "backorder_qty", ratio(F.col("lines") * 100.0, F.col("all_lines"), 1).alias("pct_of_lines"))


def by_branch(lines: DataFrame) -> DataFrame:
    sums = lines.groupBy("branch_id", "branch").agg(*_sums(), _short(), _nil(), F.max("age_days").alias("oldest_days"), F.count_if(F.col("fill_status") == "FULL").alias("full_lines"))
    return sums.select(
        "branch_id", "branch", "lines", "backordered_lines", "requested_qty", "sent_qty", "backorder_qty", "nil_lines", "oldest_days",
        ratio(F.col("sent_qty"), F.col("requested_qty"), 4).alias("fill_rate"), ratio(F.col("full_lines"), F.col("lines"), 4).alias("line_fill_rate"),
    ).orderBy("fill_rate", "branch_id")


def by_item(lines: DataFrame, top: int | None = None) -> DataFrame:
    """Items by shortfall; lines without a description don't count."""
    sums = (
        lines.filter("description is not null").groupBy("product_id", "description")
        .agg(*_sums(), F.countDistinct("dn_no").alias("documents"), F.countDistinct("branch_id").alias("branches"))
        .withColumn("fill_rate", ratio(F.col("sent_qty"), F.col("requested_qty"), 4))
    )
    return sums.orderBy(F.desc("backorder_qty"), "product_id").limit(top) if top else sums


def by_category(lines: DataFrame) -> DataFrame:
    return (
        lines.groupBy(F.coalesce("category", F.lit("(uncategorised)")).alias("category")).agg(*_sums(), _nil())
        .withColumn("fill_rate", ratio(F.col("sent_qty"), F.col("requested_qty"), 4))
    )


def ageing(lines: DataFrame) -> DataFrame:
    """Back-ordered lines by age, empty buckets kept."""
    sums = lines.filter("backorder_qty > 0").groupBy(age_bucket(F.col("age_days")).alias("bucket")).agg(F.count(F.lit(1)).alias("lines"), F.sum("backorder_qty").alias("backorder_qty"))
    return F.broadcast(_literals(lines, "bucket", AGE_BUCKETS)).join(sums, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("lines", "backorder_qty")))


def weekly_trend(lines: DataFrame) -> DataFrame:
    """By week ending Sunday; weeks without requests are absent."""
    sums = lines.groupBy(week_ending_sunday(F.col("doc_date")).alias("week_ending")).agg(*_sums())
    return sums.filter("requested_qty > 0").withColumn("fill_rate", ratio(F.col("sent_qty"), F.col("requested_qty"), 4))


def recurring(lines: DataFrame, least: int = 2) -> DataFrame:
    """Items short on `least` or more delivery notes."""
    short = lines.filter("backorder_qty > 0 and description is not null")
    return short.groupBy("product_id", "description").agg(F.countDistinct("dn_no").alias("occurrences"), F.countDistinct("branch_id").alias("branches"), F.sum("backorder_qty").alias("backorder_qty")).filter(F.col("occurrences") >= least)
