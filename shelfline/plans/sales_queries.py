"""Sales panels over the whole tables: region or nation by brand by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sales
from ..sources import tables
from .registry import register
from .views import using


def _last(n: int, view: str = "panel") -> str:
    return f"(SELECT p.*, b.back FROM {view} p JOIN (SELECT period, ROW_NUMBER() OVER (ORDER BY period DESC) AS back FROM (SELECT DISTINCT period FROM {view})) b ON p.period = b.period WHERE b.back <= {n})"


_Q, _T = "CAST(SUM(qty) AS BIGINT) AS qty", "CAST(SUM(turnover_cents) AS BIGINT) AS turnover_cents"


@register(using("panel", "SELECT branch, sku, period, qty, turnover_cents FROM panel"))
def monthly_panel(spark, sf_dir):
    return tables.monthly_panel(spark, sf_dir)


@register(using("panel", """SELECT COUNT(DISTINCT period) AS periods, COUNT(DISTINCT branch) AS branches, COUNT(DISTINCT sku) AS skus, COUNT(*) AS cells,
    MIN(period) AS first_period, MAX(period) AS last_period, string_agg(DISTINCT branch, ',' ORDER BY branch) AS branch_list FROM panel"""))
def panel_coverage(spark, sf_dir):
    return sales.coverage(tables.monthly_panel(spark, sf_dir))


@register(using("panel", f"""SELECT m.*, distinct_skus FROM (SELECT branch, CAST(SUM(qty) AS BIGINT) AS qty, CAST(SUM(turnover_cents) AS BIGINT) AS turnover_cents, COUNT(*) AS months, round_even(AVG(qty), 1) AS avg_monthly_qty,
      round_even((AVG(rate) FILTER (pos > n - GREATEST(1, n // 2)) - AVG(rate) FILTER (pos <= GREATEST(1, n // 2))) / AVG(rate) FILTER (pos <= GREATEST(1, n // 2)) * 100, 1) AS trend_pct, arg_max(days, period) < 28 AS latest_month_partial
    FROM (SELECT *, qty::DOUBLE / days AS rate, ROW_NUMBER() OVER (PARTITION BY branch ORDER BY period) AS pos, COUNT(*) OVER (PARTITION BY branch) AS n FROM
      (SELECT branch, period, SUM(qty) AS qty, SUM(turnover_cents) AS turnover_cents, MAX(day(last_day(period))) AS days FROM {_last(3)} GROUP BY branch, period)) GROUP BY branch) m
    JOIN (SELECT branch, COUNT(DISTINCT sku) AS distinct_skus FROM {_last(3)} GROUP BY branch) d ON d.branch = m.branch"""))
def branch_sales_summary(spark, sf_dir):
    return sales.branch_summary(tables.monthly_panel(spark, sf_dir))


@register(using("panel", f"SELECT period, {_Q}, {_T}, day(last_day(period)) < 28 AS partial FROM {_last(6)} GROUP BY period"))
def sales_trend(spark, sf_dir):
    return sales.trend(tables.monthly_panel(spark, sf_dir))


def _abc(source: str, key: str, value: str, digits: int | None) -> str:
    share = "running / total" if digits is None else f"round_even(running / total, {digits})"
    return f"""SELECT {key}, {value}, round_even({value} * 100.0::DOUBLE / total, 3) AS pct, round_even({share} * 100, 1) AS cum_pct,
    CASE WHEN {share} <= 0.8 THEN 'A' WHEN {share} <= 0.95 THEN 'B' ELSE 'C' END AS abc FROM (
    SELECT {key}, {value}, SUM({value}) OVER (ORDER BY {value} DESC, {key} ROWS UNBOUNDED PRECEDING)::DOUBLE AS running, SUM({value}) OVER ()::DOUBLE AS total
    FROM ({source}) WHERE {value} > 0)"""


_BY_SKU = f"SELECT sku, CAST(SUM(turnover_cents) AS BIGINT) AS turnover_cents FROM {_last(3)} GROUP BY sku"
_BY_PRODUCT = "SELECT product_id, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents FROM dn GROUP BY product_id"


@register(using("panel", _abc(_BY_SKU, "sku", "turnover_cents", 4)))
def abc_by_turnover(spark, sf_dir):
    recent = sales.last_periods(tables.monthly_panel(spark, sf_dir), 3)
    return sales.abc(recent.groupBy("sku").agg(F.sum("turnover_cents").alias("turnover_cents")), "sku", "turnover_cents", 4)


BY_REVENUE_SQL = _abc(_BY_PRODUCT, "product_id", "revenue_cents", None)


def product_classes(spark, sf_dir):
    revenue = tables.delivery_lines(spark, sf_dir, product=False).groupBy("product_id").agg(F.sum("revenue_cents").alias("revenue_cents"))
    return sales.abc(revenue, "product_id", "revenue_cents")


@register(using("dn", _abc(_BY_PRODUCT, "product_id", "revenue_cents", None)))
def abc_by_revenue(spark, sf_dir):
    return product_classes(spark, sf_dir)


@register(using("dn", f"SELECT abc, COUNT(*) AS items, CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents FROM ({_abc(_BY_PRODUCT, 'product_id', 'revenue_cents', None)}) GROUP BY abc"))
def abc_summary(spark, sf_dir):
    return sales.abc_summary(product_classes(spark, sf_dir), "revenue_cents")


@register(using("dn", f"""SELECT h.*, w.*, round_even((qty_now - qty_before) * 100.0::DOUBLE / qty_before, 1) AS qty_pct,
    round_even((turnover_cents_now - turnover_cents_before) * 100.0::DOUBLE / turnover_cents_before, 1) AS turnover_pct, b.top_branch, b.top_branch_pct, s.*, p.*
    FROM (SELECT MAX(period) AS period, CAST(SUM(qty) FILTER (back = 1) AS BIGINT) AS qty_now, CAST(SUM(qty) FILTER (back = 2) AS BIGINT) AS qty_before,
      CAST(SUM(turnover_cents) FILTER (back = 1) AS BIGINT) AS turnover_cents_now, CAST(SUM(turnover_cents) FILTER (back = 2) AS BIGINT) AS turnover_cents_before FROM {_last(2, 'earned')}) h,
    (SELECT COUNT(DISTINCT period) AS periods, round_even(SUM(profit_cents) * 100.0::DOUBLE / SUM(turnover_cents), 1) AS margin_pct FROM earned) w,
    (SELECT branch AS top_branch, round_even(q * 100.0::DOUBLE / total, 1) AS top_branch_pct FROM (SELECT branch, SUM(qty) AS q, SUM(SUM(qty)) OVER () AS total FROM earned GROUP BY branch) ORDER BY q DESC, branch LIMIT 1) b,
    (SELECT sku AS top_sku, CAST(q AS BIGINT) AS top_sku_qty, round_even(q * 100.0::DOUBLE / total, 1) AS top_sku_pct FROM (SELECT sku, SUM(qty) AS q, SUM(SUM(qty)) OVER () AS total FROM earned GROUP BY sku) ORDER BY q DESC, sku LIMIT 1) s,
    (SELECT sku AS top_profit_sku, CAST(q AS BIGINT) AS top_profit_sku_profit_cents, round_even(q * 100.0::DOUBLE / total, 1) AS top_profit_sku_pct FROM (SELECT sku, SUM(profit_cents) AS q, SUM(SUM(profit_cents)) OVER () AS total FROM earned GROUP BY sku) ORDER BY q DESC, sku LIMIT 1) p""",
    earned="""SELECT region AS branch, brand AS sku, CAST(date_trunc('month', doc_date) AS DATE) AS period, CAST(SUM(requested_qty) AS BIGINT) AS qty, CAST(SUM(revenue_cents) AS BIGINT) AS turnover_cents,
      CAST(SUM(revenue_cents - requested_qty * price_cents) AS BIGINT) AS profit_cents FROM dn GROUP BY ALL"""))
def sales_flow_summary(spark, sf_dir):
    """Profit is what lines bring over the list price."""
    lines = tables.delivery_lines(spark, sf_dir)
    profit = F.sum(F.col("revenue_cents") - F.col("requested_qty") * F.col("price_cents"))
    months = lines.groupBy(F.col("region").alias("branch"), F.col("brand").alias("sku"), F.trunc("doc_date", "month").alias("period"))
    return sales.flow_summary(months.agg(F.sum("requested_qty").alias("qty"), F.sum("revenue_cents").alias("turnover_cents"), profit.alias("profit_cents")))


@register(using("panel", f"""SELECT period, qty, active_branches, active_skus, round_even((qty - LAG(qty) OVER o) * 100.0::DOUBLE / LAG(qty) OVER o, 1) AS change_pct,
    round_even((SUM(qty) FILTER (back <= 6) OVER () - SUM(qty) FILTER (back > 6) OVER ()) * 100.0::DOUBLE / SUM(qty) FILTER (back > 6) OVER (), 1) AS growth_pct
    FROM (SELECT period, back, {_Q}, COUNT(DISTINCT branch) FILTER (qty > 0) AS active_branches, COUNT(DISTINCT sku) FILTER (qty > 0) AS active_skus
    FROM {_last(12)} GROUP BY period, back) WINDOW o AS (ORDER BY period)"""))
def growth_overview(spark, sf_dir):
    return sales.growth(tables.monthly_panel(spark, sf_dir))


@register(using("panel", f"""SELECT g.branch, g.period, COALESCE(qty, 0) AS qty, COALESCE(turnover_cents, 0) AS turnover_cents FROM
    (SELECT branch, period FROM (SELECT DISTINCT branch FROM panel), (SELECT CAST(unnest(generate_series(MIN(period), MAX(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM panel)) g
    LEFT JOIN (SELECT branch, period, {_Q}, {_T} FROM panel WHERE contains(lower(sku), 'brand#1') GROUP BY branch, period) s ON g.branch = s.branch AND g.period = s.period"""))
def sales_series_by_branch(spark, sf_dir):
    """Brands whose name contains Brand#1, on every month."""
    return sales.series(tables.monthly_panel(spark, sf_dir), query="Brand#1")


def _mix(key: str) -> str:
    return f"""SELECT place, label, qty, round_even(qty * 100.0::DOUBLE / SUM(qty) OVER (), 1) AS pct FROM (
    SELECT CAST(LEAST(place, 9) AS INTEGER) AS place, CASE WHEN place <= 8 THEN {key} ELSE 'Other' END AS label, {_Q} FROM (
      SELECT {key}, qty, ROW_NUMBER() OVER (ORDER BY qty DESC, {key}) AS place FROM (SELECT {key}, SUM(qty) AS qty FROM
        (SELECT branch, sku, SUM(qty) AS qty FROM {_last(12, 'fine')} GROUP BY branch, sku HAVING SUM(qty) > 0) GROUP BY {key})) GROUP BY 1, 2)"""


@register(using("fine", _mix("sku")))
def sales_mix(spark, sf_dir):
    return sales.mix(tables.monthly_panel(spark, sf_dir, "branch"), "sku")


@register(using("fine", _mix("branch")))
def branch_mix(spark, sf_dir):
    return sales.mix(tables.monthly_panel(spark, sf_dir, "branch"), "branch")
