"""Loads in two rounds, each table held against SQL that builds it at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import weeks
from ..sources import tables
from ..streaming import jobs, loads
from .registry import register
from .views import using

_MONTHS = """SELECT region AS branch, CAST(date_trunc('month', doc_date) AS DATE) AS period, brand AS sku, MIN(description) AS item, CAST(SUM(requested_qty) AS BIGINT) AS qty, CAST(SUM(revenue_cents) AS BIGINT) AS turnover_cents,
    MAX(CASE WHEN date_trunc('month', doc_date) = date_trunc('month', (SELECT MAX(doc_date) FROM dn)) THEN day((SELECT MAX(doc_date) FROM dn)) ELSE 31 END) AS day_to FROM dn GROUP BY 1, 2, 3"""
_REAL = """SELECT region AS branch, CAST(date_trunc('week', doc_date) AS DATE) AS week_start, brand AS sku, MIN(description) AS item, CAST(SUM(requested_qty) AS DOUBLE) AS qty, CAST(SUM(revenue_cents) AS BIGINT) / 100 AS turnover
    FROM dn WHERE (CAST(date_trunc('week', doc_date) AS DATE) - DATE '1995-01-02') // 7 % 3 = 0 GROUP BY 1, 2, 3"""
_OPEN = """SELECT branch, period, CAST(date_trunc('week', d) AS DATE) AS week_start, COUNT(*) FILTER (NOT covered) AS days, ANY_VALUE(span) AS span FROM (
    SELECT branch, period, d, COUNT(*) OVER (PARTITION BY branch, period) AS span, EXISTS (SELECT 1 FROM (SELECT DISTINCT branch, week_start FROM real) r WHERE r.branch = s.branch AND d BETWEEN week_start AND week_start + 6) AS covered FROM (
      SELECT branch, period, CAST(unnest(generate_series(period, LEAST(last_day(period), period + CAST(MAX(day_to) - 1 AS INTEGER)), INTERVAL 1 DAY)) AS DATE) AS d FROM months GROUP BY branch, period) s) GROUP BY 1, 2, 3"""
_WEEKLY = """SELECT *, FALSE AS simulated FROM real UNION ALL
    SELECT branch, week_start, sku, item, round_even(q, 2), round_even(v, 0) / 100, TRUE FROM (SELECT m.branch, week_start, sku, ARG_MIN(item, m.period) AS item, SUM(qty * days / span) AS q, SUM(turnover_cents * days / span) AS v
    FROM months m JOIN open o ON o.branch = m.branch AND o.period = m.period WHERE days > 0 GROUP BY 1, 2, 3) WHERE q > 0"""
_SQL = using("dn", _WEEKLY, months=_MONTHS, real=_REAL, open=_OPEN)


def _months(spark, sf_dir):
    """Months of each region as uploaded, the last one up to the last day there is."""
    lines = tables.delivery_lines(spark, sf_dir)
    last = tables.notes(spark, sf_dir).agg(F.max("doc_date").alias("last"))
    sums = lines.groupBy(F.col("region").alias("branch"), F.trunc("doc_date", "month").alias("period"), F.col("brand").alias("sku")).agg(
        F.min("description").alias("item"), F.sum("requested_qty").alias("qty"), F.sum("revenue_cents").alias("turnover_cents")
    )
    day_to = F.when(F.col("period") == F.trunc("last", "month"), F.dayofmonth("last")).otherwise(31)
    return sums.crossJoin(F.broadcast(last)).select("branch", "period", "sku", "item", "qty", "turnover_cents", F.lit(1).alias("day_from"), day_to.alias("day_to"))  # last is one row


def _real(spark, sf_dir):
    """Every third week of each region as a real reading."""
    lines = tables.delivery_lines(spark, sf_dir).withColumn("week_start", weeks.monday(F.col("doc_date")))
    third = F.pmod(F.floor(F.datediff("week_start", F.lit("1995-01-02")) / 7), F.lit(3)) == 0
    return lines.filter(third).groupBy(F.col("region").alias("branch"), "week_start", F.col("brand").alias("sku")).agg(
        F.min("description").alias("item"), F.sum("requested_qty").cast("double").alias("qty"), (F.sum("revenue_cents") / 100).alias("turnover")
    )


@register(_SQL)
def simulated_weeks(spark, sf_dir):
    """Real weeks and the simulated ones around them, at once."""
    return weeks.weekly_table(_months(spark, sf_dir), _real(spark, sf_dir))


@register(_SQL)
def stream_simulated_weeks(spark, sf_dir):
    """The same table from two rounds of loads: months up to 1999 come first, the last of them with too much, and real weeks
    up to 1997; then the months from 1999 on, and all real weeks from 1997 on."""
    folder = jobs.work_folder(spark, "simulated-weeks")
    months, real = _months(spark, sf_dir), _real(spark, sf_dir).withColumn("month", F.trunc("week_start", "month"))
    first = months.filter("period < '2000-01-01'").withColumn("qty", F.when(F.year("period") == 1999, F.col("qty") * 2 + 5).otherwise(F.col("qty")))
    rounds = [(first, real.filter("month < '1998-01-01'")), (months.filter("period >= '1999-01-01'"), real.filter("month >= '1997-01-01'"))]
    for i, (some_months, some_weeks) in enumerate(rounds):
        some_months.coalesce(1).write.parquet(f"{folder}/in-months/{i}")
        some_weeks.coalesce(1).write.parquet(f"{folder}/in-weeks/{i}")
        loads.load_months(spark, f"{folder}/in-months", f"{folder}/table", f"{folder}/c-months")
        loads.load_weeks(spark, f"{folder}/in-weeks", f"{folder}/table", f"{folder}/c-weeks")
    return loads.weeks_of(spark, f"{folder}/table")


@register(using("dn", """SELECT branch, period, sku, qty + CASE WHEN year(period) = 1998 AND month(period) = 4 THEN 1 ELSE 0 END AS qty,
    CAST(CASE WHEN year(period) = 1998 AND month(period) = 4 THEN 2 ELSE 1 END AS INTEGER) AS built FROM months""", months=_MONTHS))
def refreshed_panel(spark, sf_dir):
    """A panel kept by signature over three loads: all months, then 1998 again with a change in April, then 1998 as it was
    loaded before, which rebuilds nothing."""
    folder = jobs.work_folder(spark, "refreshed-panel")
    months, keys = _months(spark, sf_dir), ["period"]
    changed = months.filter("year(period) = 1998").withColumn("qty", F.col("qty") + F.when(F.month("period") == 4, 1).otherwise(0))

    def rebuild(touched, number):
        source = loads.table_of(spark, f"{folder}/months", loads.MONTHS).drop("load", "simulated")
        loads.refresh(source, keys, lambda rows: rows.groupBy("branch", "period", "sku").agg(F.sum("qty").alias("qty")), f"{folder}/panel")

    for i, rows in enumerate((months, changed, changed)):
        rows.coalesce(1).write.parquet(f"{folder}/in/{i}")
        loads.load_once(spark, f"{folder}/in", loads.MONTHS, f"{folder}/months", keys, f"{folder}/c", then=rebuild)
    return loads.refreshed(spark, f"{folder}/panel", keys).select("branch", "period", "sku", "qty", "built")
