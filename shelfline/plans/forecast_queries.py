"""Forecasts over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast, panel
from ..sources import tables
from .panel_queries import _ALL, damped_sql, dense, dense_sql
from .registry import register
from .sales_queries import BY_REVENUE_SQL, product_classes
from .views import using


def _series(spark, sf_dir, by="region"):
    return panel.as_arrays(dense(spark, sf_dir, by))


@register(using("panel", """SELECT branch, sku, CAST(h AS INTEGER) AS h, CAST(qty AS DOUBLE) AS yhat FROM (SELECT branch, sku, t - MAX(t) OVER (PARTITION BY branch, sku) + 3 AS k, qty FROM dense) d
    JOIN (SELECT unnest(range(0, 6)) AS h) ON k = h % 4 WHERE k >= 0""", dense=dense_sql()))
def seasonal_naive(spark, sf_dir):
    return _series(spark, sf_dir).select("branch", "sku", F.posexplode(forecast.seasonal_naive(F.col("y"), 6)).alias("h", "yhat"))


_WALK = """SELECT branch, sku, CAST(0 AS INTEGER) AS t, CAST(NULL AS DOUBLE) AS z, 0::DOUBLE AS p, 1::DOUBLE AS q FROM (SELECT DISTINCT branch, sku FROM dense) UNION ALL
    SELECT w.branch, w.sku, d.t, CASE WHEN d.qty > 0 THEN CASE WHEN z IS NULL THEN d.qty ELSE 0.1::DOUBLE * d.qty + 0.9::DOUBLE * z END ELSE z END,
    CASE WHEN d.qty > 0 THEN CASE WHEN z IS NULL THEN q ELSE 0.1::DOUBLE * q + 0.9::DOUBLE * p END ELSE p END, CASE WHEN d.qty > 0 THEN 1 ELSE q + 1 END
    FROM walk w JOIN dense d ON w.branch = d.branch AND w.sku = d.sku AND d.t = w.t + 1"""
_RATES = "SELECT branch, sku, COALESCE(0.95::DOUBLE * z / p, 0) AS rate FROM (SELECT branch, sku, arg_max(z, t) AS z, arg_max(p, t) AS p FROM walk GROUP BY branch, sku)"
_LAST4 = "SELECT branch, sku, t - n + 4 AS t, 4 AS n, qty FROM (SELECT *, MAX(t) OVER (PARTITION BY branch, sku) AS n FROM dense) WHERE t > n - 4"


@register("WITH RECURSIVE " + using("fine", "SELECT branch, sku, round_even(rate, 6) AS rate FROM rates", dense=dense_sql("fine"), walk=_WALK, rates=_RATES)[5:])
def croston_rate(spark, sf_dir):
    return _series(spark, sf_dir, "branch").select("branch", "sku", F.bround(forecast.croston(F.col("y")), 6).alias("rate"))


@register(using("panel", "SELECT branch, sku, CEIL(round_even(qty * 1.1::DOUBLE, 6)) AS forecast FROM (SELECT *, MAX(t) OVER (PARTITION BY branch, sku) AS n FROM dense) WHERE t = n", dense=dense_sql()))
def last_month_rule(spark, sf_dir):
    return _series(spark, sf_dir).select("branch", "sku", forecast.last_month_rule(F.col("y")).alias("forecast"))


@register("WITH RECURSIVE " + using("fine", f"""SELECT a.branch, a.sku, round_even(CASE WHEN live THEN GREATEST(level, rate) ELSE level END, 6) AS level FROM ({damped_sql(_LAST4)}) a JOIN rates r ON a.branch = r.branch AND a.sku = r.sku
    JOIN (SELECT branch, sku, MAX(qty) FILTER (t > n - 6) > 0 AS live FROM ({_ALL}) GROUP BY branch, sku) b ON a.branch = b.branch AND a.sku = b.sku""", dense=dense_sql("fine"), walk=_WALK, rates=_RATES)[5:])
def ratio_base_level(spark, sf_dir):
    return forecast.ratio_base(_series(spark, sf_dir, "branch"), "level").select("branch", "sku", F.bround("level", 6).alias("level"))


_LAST6 = """SELECT branch, sku, t - n + 6 AS i, qty FROM (SELECT *, MAX(t) OVER (PARTITION BY branch, sku) AS n FROM dense) WHERE t > n - 6 AND t <= n"""


def _monthly(source: str, m: int) -> str:
    """From rows (branch, sku, i = 1..m, qty) to the monthly forecast before rounding."""
    return f"""SELECT branch, sku, nnz, last, CASE WHEN nnz = 0 THEN 0 WHEN nnz = 1 AND last > 0 THEN 0.6::DOUBLE * last WHEN last = 0 THEN 0.35::DOUBLE * s / nnz ELSE w END * 1.05::DOUBLE AS point,
    q1, q2, q3, sd, sd_sold / (s::DOUBLE / nnz) AS cv FROM (
    SELECT branch, sku, COUNT(*) FILTER (qty > 0) AS nnz, SUM(qty) AS s, arg_max(qty, i) AS last, SUM(qty * pow(0.55::DOUBLE, {m} - i)) / SUM(pow(0.55::DOUBLE, {m} - i)) AS w,
    MAX(qty) FILTER (i = 1) AS q1, MAX(qty) FILTER (i = 2) AS q2, MAX(qty) FILTER (i = 3) AS q3, sqrt(SUM(qty * qty)::DOUBLE / {m} - pow(SUM(qty)::DOUBLE / {m}, 2)) AS sd,
    sqrt(SUM(qty * qty)::DOUBLE / COUNT(*) FILTER (qty > 0) - pow(SUM(qty)::DOUBLE / COUNT(*) FILTER (qty > 0), 2)) AS sd_sold FROM ({source}) GROUP BY branch, sku)"""


MONTHLY_SQL = f"""SELECT branch, sku, round_even(point + 1e-9::DOUBLE, 4) AS point, round_even(sigma + 1e-9::DOUBLE, 4) AS sigma, round_even(GREATEST(0, point - 1.28::DOUBLE * sigma) + 1e-9::DOUBLE, 4) AS low,
    round_even(point + 1.28::DOUBLE * sigma + 1e-9::DOUBLE, 4) AS high, CAST(nnz AS INTEGER) AS months_sold,
    CASE WHEN nnz = 0 THEN 'none' WHEN nnz = 1 AND last > 0 THEN 'new' WHEN last <= 0 THEN 'dropped' WHEN q2 > q1 AND q3 > q2 THEN 'growing' WHEN q2 < q1 AND q3 < q2 THEN 'declining'
         WHEN nnz < 6 THEN 'intermittent' ELSE 'regular' END AS pattern,
    CASE WHEN nnz <= 1 THEN 'Low' WHEN nnz = 6 AND COALESCE(cv, 0) <= 0.6 THEN 'High' ELSE 'Medium' END AS confidence
    FROM (SELECT *, CASE WHEN nnz = 0 THEN 0 WHEN nnz >= 2 THEN sd ELSE 0.7::DOUBLE * point END AS sigma FROM ({_monthly(_LAST6, 6)}))"""


@register(using("fine", MONTHLY_SQL, dense=dense_sql("fine")))
def monthly_forecast(spark, sf_dir):
    """The month after the last six of each nation and brand."""
    return forecast.monthly_forecast(_series(spark, sf_dir, "branch").withColumn("y", panel.tail(F.col("y"), 6)))


_BEFORE = "SELECT branch, sku, t - n + 7 AS i, qty FROM (SELECT *, MAX(t) OVER (PARTITION BY branch, sku) AS n FROM dense) WHERE t > n - 7 AND t < n"


@register(using("panel", f"""SELECT COUNT(*) AS series, round_even(wape, 2) AS wape, round_even(wape_last, 2) AS wape_last, round_even(wape_mean, 2) AS wape_mean, round_even(bias, 2) AS bias,
    round_even((wape_last - wape) / wape_last * 100, 1) AS skill_pct FROM (SELECT COUNT(*) AS n, SUM(ABS(f - a)) * 100 / SUM(a) AS wape, SUM(ABS(last - a))::DOUBLE * 100 / SUM(a) AS wape_last,
      SUM(ABS(mean - a)) * 100 / SUM(a) AS wape_mean, SUM(f - a) * 100 / SUM(a) AS bias FROM (SELECT round_even(m.point + 1e-9::DOUBLE, 4) AS f, m.last, x.mean, y.qty AS a FROM ({_monthly(_BEFORE, 6)}) m
      JOIN (SELECT branch, sku, AVG(qty) AS mean FROM ({_BEFORE}) GROUP BY branch, sku) x ON m.branch = x.branch AND m.sku = x.sku
      JOIN (SELECT branch, sku, arg_max(qty, t) AS qty FROM dense GROUP BY branch, sku) y ON m.branch = y.branch AND m.sku = y.sku)), (SELECT DISTINCT branch, sku FROM dense)
    GROUP BY ALL""", dense=dense_sql()))
def forecast_backtest(spark, sf_dir):
    """The last month of each region and brand from the six before."""
    return forecast.backtest(_series(spark, sf_dir).withColumn("y", panel.tail(F.col("y"), 7)))


_UNION = "SELECT region AS branch, product_id AS sku, CAST(date_trunc('month', doc_date) AS DATE) AS period, CAST(SUM(requested_qty) AS BIGINT) AS qty FROM dn GROUP BY ALL"
_SKILL = "CASE WHEN {0} <> 0 THEN round_even(100 * (1 - wape_pct / (100 * {0} / NULLIF(t, 0))), 1) END"


@register(using("dn", f"""SELECT scope, series, wape_pct, mae, bias_pct, {_SKILL.format('el')} AS skill_vs_last_pct, {_SKILL.format('em')} AS skill_vs_mean_pct FROM (
    SELECT CASE WHEN grouping(branch) = 1 THEN 'all' ELSE branch END AS scope, COUNT(*) FILTER (a > 0 OR f > 0) AS series, SUM(a) AS t, SUM(ABS(last - a)) AS el, SUM(ABS(mean - a)) AS em, round_even(100 * SUM(ABS(f - a)) / NULLIF(SUM(a), 0), 1) AS wape_pct,
      round_even(AVG(ABS(f - a)), 2) AS mae, round_even(100 * SUM(f - a) / NULLIF(SUM(a), 0), 1) AS bias_pct FROM (
      SELECT COALESCE(m.branch, x.branch) AS branch, COALESCE(f, 0)::DOUBLE AS f, COALESCE(last, 0)::DOUBLE AS last, COALESCE(mean, 0)::DOUBLE AS mean, COALESCE(a, 0)::DOUBLE AS a
      FROM (SELECT p.branch, p.sku, round_even(point + 1e-9::DOUBLE, 4) AS f, last, mean FROM ({_monthly(_LAST6, 6)}) p JOIN (SELECT branch, sku, SUM(qty)::DOUBLE / 6 AS mean FROM ({_LAST6}) GROUP BY ALL) q ON p.branch = q.branch AND p.sku = q.sku) m
      FULL JOIN (SELECT branch, sku, qty AS a FROM goods WHERE period = (SELECT MAX(period) FROM goods)) x ON m.branch = x.branch AND m.sku = x.sku) GROUP BY ROLLUP (branch))""",
    goods=_UNION, trained="SELECT * FROM goods WHERE period < (SELECT MAX(period) FROM goods)", dense=dense_sql("trained")))
def union_backtest(spark, sf_dir):
    """The last month of each region and product, those that it has no history of included."""
    months = tables.delivery_lines(spark, sf_dir, product=False).groupBy(F.col("region").alias("branch"), F.col("product_id").alias("sku"), F.trunc("doc_date", "month").alias("period"))
    return forecast.union_backtest(months.agg(F.sum("requested_qty").alias("qty")))


_ORDER_UP_TO = """SELECT branch_id, product_id, round_even(daily, 6) AS daily, round_even(sigma, 6) AS sigma, round_even(safety, 4) AS safety_stock, round_even(daily * 7 + safety, 4) AS reorder_point,
    round_even(daily * 7 + safety + daily * 7, 4) AS target_level FROM (SELECT *, 1.65::DOUBLE * sigma * sqrt(7.0::DOUBLE) AS safety FROM (
    SELECT branch_id, product_id, SUM(q * (0.5::DOUBLE + (89 - age) / 89.0::DOUBLE)) / 90 AS daily, sqrt(SUM(q * q)::DOUBLE / 90 - pow(SUM(q) / 90.0::DOUBLE, 2)) AS sigma FROM (
      SELECT branch_id, product_id, age_days AS age, SUM(requested_qty) AS q FROM lines WHERE age_days >= 0 AND age_days < 90 GROUP BY 1, 2, 3) GROUP BY 1, 2))"""


@register(using("lines", _ORDER_UP_TO))
def order_up_to(spark, sf_dir):
    return forecast.order_up_to(tables.delivery_lines(spark, sf_dir), tables.as_of())


@register(using("lines", _ORDER_UP_TO.replace("1.65::DOUBLE *", "CASE abc WHEN 'A' THEN 2.3263::DOUBLE WHEN 'B' THEN 1.96::DOUBLE WHEN 'C' THEN 1.2816::DOUBLE ELSE 1.6449::DOUBLE END *").replace("GROUP BY 1, 2))", "GROUP BY 1, 2) LEFT JOIN classes USING (product_id))"),
    classes=f"SELECT product_id, abc FROM ({BY_REVENUE_SQL})"))
def order_up_to_by_class(spark, sf_dir):
    """Order levels with a service level by the product's class of revenue."""
    level = F.when(F.col("abc") == "A", 0.99).when(F.col("abc") == "B", 0.975).otherwise(0.9)
    levels = product_classes(spark, sf_dir).select("product_id", level.alias("service_level"))
    return forecast.order_up_to(tables.delivery_lines(spark, sf_dir, product=False), tables.as_of(), levels=levels)


@register()
def model_scores(spark, sf_dir):
    """Five models on the last three months of each region and brand."""
    return forecast.scores(_series(spark, sf_dir))


@register("WITH RECURSIVE " + using("panel", f"""SELECT a.branch, a.sku, CAST(h AS INTEGER) AS h, round_even(0.5::DOUBLE * level + 0.3::DOUBLE * rate + 0.2::DOUBLE * qty, 4) AS yhat FROM ({damped_sql(_ALL)}) a JOIN rates r ON a.branch = r.branch AND a.sku = r.sku
    JOIN (SELECT branch, sku, t - n + 3 AS h, qty FROM ({_ALL}) WHERE t > n - 4) s ON a.branch = s.branch AND a.sku = s.sku WHERE h < 3""", dense=dense_sql(), walk=_WALK, rates=_RATES)[5:])
def model_blend(spark, sf_dir):
    levels = forecast.model_levels(_series(spark, sf_dir), 3)
    made = forecast.blend(levels, {"damped": 0.5, "sba": 0.3, "snaive": 0.2})
    return made.select("branch", "sku", "h", F.bround("yhat", 4).alias("yhat"))
