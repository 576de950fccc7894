"""Planning views over the whole tables."""

from __future__ import annotations

from ..operators import planning
from ..sources import tables
from .registry import register
from .views import using

_RATES = """SELECT branch_id, product_id, SUM(requested_qty)::DOUBLE / 26 AS rate,
    CAST(COALESCE(SUM(sent_qty) FILTER (doc_date > DATE '2001-08-31' - 28), 0) AS BIGINT) AS recent_sales, COUNT(DISTINCT date_trunc('week', doc_date)) AS weeks_sold,
    CAST(SUM(revenue_cents) AS BIGINT) AS revenue_cents, CAST(SUM(requested_qty) AS BIGINT) AS units
    FROM lines WHERE doc_date > DATE '2001-08-31' - 182 AND doc_date <= DATE '2001-08-31' GROUP BY branch_id, product_id"""


def _rates(spark, sf_dir):
    return planning.weekly_rates(tables.delivery_lines(spark, sf_dir, product=False), tables.as_of())


@register(using("lines", "SELECT branch_id, product_id, round_even(rate, 6) AS rate, recent_sales, weeks_sold, revenue_cents, units FROM rates", rates=_RATES))
def weekly_rates(spark, sf_dir):
    return _rates(spark, sf_dir).selectExpr("branch_id", "product_id", "bround(rate, 6) as rate", "recent_sales", "weeks_sold", "revenue_cents", "units")


@register(using("lines", """SELECT branch_id, product_id, round_even(rate, 6) AS rate, 'model' AS basis FROM rates UNION ALL
    SELECT branch_id, product_id, round_even(SUM(requested_qty)::DOUBLE / 4, 6), 'last month' FROM lines WHERE doc_date > DATE '2001-08-31' - 30 AND doc_date <= DATE '2001-08-31'
    AND branch_id NOT IN (SELECT branch_id FROM rates) GROUP BY branch_id, product_id""", rates=_RATES))
def weekly_demand_estimate(spark, sf_dir):
    found = planning.demand_estimate(_rates(spark, sf_dir), tables.delivery_lines(spark, sf_dir, product=False), tables.as_of())
    return found.selectExpr("branch_id", "product_id", "bround(rate, 6) as rate", "basis")


@register(using("lines stock", """SELECT r.branch_id, r.product_id, on_hand, round_even(rate, 4) AS rate, round_even(round_even(on_hand / rate, 8), 2) AS cover_weeks, COUNT(*) OVER () AS total_alerts,
    (SELECT COUNT(*) FROM net WHERE network >= (SELECT round_even(quantile_cont(network, 0.75), 8) FROM net)) AS priority_products FROM rates r
    JOIN net n ON r.product_id = n.product_id JOIN stock s ON r.branch_id = s.branch_id AND r.product_id = s.product_id
    WHERE rate > 0 AND on_hand / rate < 1.5 AND network >= (SELECT round_even(quantile_cont(network, 0.75), 8) FROM net)
    ORDER BY round_even(rate, 4) DESC, r.branch_id, r.product_id LIMIT 50""", rates=_RATES, net="SELECT product_id, round_even(SUM(rate), 8) AS network FROM rates GROUP BY product_id HAVING round_even(SUM(rate), 8) > 0"))
def low_stock_alerts(spark, sf_dir):
    return planning.low_stock(_rates(spark, sf_dir), tables.stock_levels(spark, sf_dir))


_POINTS = """SELECT r.branch_id, r.product_id, COALESCE(on_hand, 0) AS on_hand, CAST(round_even(rate * 1.2::DOUBLE, 0) AS BIGINT) AS safety_stock,
    CAST(round_even(rate * 1.2::DOUBLE + rate * 2, 0) AS BIGINT) AS reorder_point, round_even(round_even(COALESCE(on_hand, 0) / (rate / 7), 8), 1) AS days_left,
    CASE WHEN COALESCE(on_hand, 0) <= 0 THEN 'out' WHEN COALESCE(on_hand, 0) < rate * 1.2::DOUBLE + rate * 2 THEN 'reorder' ELSE 'ok' END AS status
    FROM rates r LEFT JOIN stock s ON r.branch_id = s.branch_id AND r.product_id = s.product_id WHERE rate > 0"""


@register(using("lines stock", "SELECT * FROM points", rates=_RATES, points=_POINTS))
def reorder_points(spark, sf_dir):
    return planning.reorder_points(_rates(spark, sf_dir), tables.stock_levels(spark, sf_dir))


@register(using("lines stock", """SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY status = 'ok', days_left, branch_id, product_id) AS INTEGER) AS place, COUNT(*) OVER () AS products, COUNT(*) FILTER (status <> 'ok') OVER () AS to_reorder
    FROM points ORDER BY place LIMIT 300""", rates=_RATES, points=_POINTS))
def first_to_reorder(spark, sf_dir):
    return planning.first_to_reorder(planning.reorder_points(_rates(spark, sf_dir), tables.stock_levels(spark, sf_dir)))


@register(using("lines stock", """SELECT s.branch_id, s.product_id, on_hand, CASE WHEN rate > 0 THEN round_even(round_even(on_hand / rate, 8), 1) END AS cover_weeks, COALESCE(rate <= 0, TRUE) AS dead
    FROM stock s LEFT JOIN rates r ON r.branch_id = s.branch_id AND r.product_id = s.product_id
    WHERE on_hand > 0 AND (COALESCE(rate <= 0, TRUE) OR round_even(round_even(on_hand / rate, 8), 1) > 12)""", rates=_RATES))
def excess_stock(spark, sf_dir):
    return planning.excess_stock(_rates(spark, sf_dir), tables.stock_levels(spark, sf_dir))


@register(using("lines stock", """SELECT branch_id, place, product_id, on_hand, units, revenue_cents, score FROM (
    SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY branch_id ORDER BY score, product_id) AS INTEGER) AS place FROM (
      SELECT branch_id, product_id, on_hand, units, revenue_cents, round_even(
        (RANK() OVER (PARTITION BY branch_id ORDER BY units) + (COUNT(*) OVER (PARTITION BY branch_id, units) - 1) / 2.0::DOUBLE) / COUNT(*) OVER (PARTITION BY branch_id)
        + (RANK() OVER (PARTITION BY branch_id ORDER BY revenue_cents) + (COUNT(*) OVER (PARTITION BY branch_id, revenue_cents) - 1) / 2.0::DOUBLE) / COUNT(*) OVER (PARTITION BY branch_id), 6) AS score
      FROM (SELECT s.branch_id, s.product_id, on_hand, COALESCE(units, 0) AS units, COALESCE(revenue_cents, 0) AS revenue_cents FROM stock s
            LEFT JOIN rates r ON r.branch_id = s.branch_id AND r.product_id = s.product_id WHERE on_hand > 0))) WHERE place <= 15""", rates=_RATES))
def worst_performers(spark, sf_dir):
    return planning.worst_performers(_rates(spark, sf_dir), tables.stock_levels(spark, sf_dir))


@register(using("lines stock", """SELECT * FROM (SELECT r.branch_id, r.product_id, COALESCE(on_hand, 0) AS on_hand, round_even(GREATEST(rate, recent_sales / 4.0::DOUBLE), 4) AS demand,
    CAST(CEIL(round_even(GREATEST(rate, recent_sales / 4.0::DOUBLE) * 10 / 7, 6)) AS BIGINT) AS target,
    GREATEST(0, CAST(CEIL(round_even(GREATEST(rate, recent_sales / 4.0::DOUBLE) * 10 / 7, 6)) AS BIGINT) - COALESCE(on_hand, 0)) AS to_transport
    FROM rates r LEFT JOIN stock s ON r.branch_id = s.branch_id AND r.product_id = s.product_id) WHERE to_transport > 0""", rates=_RATES))
def transport_plan(spark, sf_dir):
    return planning.transport_plan(_rates(spark, sf_dir), tables.stock_levels(spark, sf_dir))


@register(using("lines stock", """SELECT scope, place, branch_id, product_id, on_hand, units, revenue_cents, round_even(100 * units / tu, 4) AS units_pct, round_even(100 * revenue_cents / tr, 4) AS revenue_pct,
    CASE WHEN units > 0 THEN round_even(round_even(on_hand / (units / 26), 8), 1) END AS cover_weeks, units = 0 AS dead, round_even(points / (2 * n), 6) AS score FROM (
    SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY scope ORDER BY points, on_hand DESC, branch_id, product_id) AS INTEGER) AS place FROM (
      SELECT *, COUNT(*) OVER (PARTITION BY scope) AS n, (2 * RANK() OVER (PARTITION BY scope ORDER BY units) + COUNT(*) OVER (PARTITION BY scope, units) - 1) + (2 * RANK() OVER (PARTITION BY scope ORDER BY revenue_cents) + COUNT(*) OVER (PARTITION BY scope, revenue_cents) - 1) AS points FROM both_ WHERE on_hand > 0)), (SELECT SUM(units) AS tu, SUM(GREATEST(revenue_cents, 0)) AS tr FROM both_ WHERE scope = 'overall')
    WHERE place <= 15""", rates=_RATES, known="SELECT COALESCE(s.branch_id, r.branch_id) AS branch_id, COALESCE(s.product_id, r.product_id) AS product_id, COALESCE(on_hand, 0) AS on_hand, COALESCE(units, 0) AS units, COALESCE(revenue_cents, 0) AS revenue_cents FROM stock s FULL JOIN rates r ON r.branch_id = s.branch_id AND r.product_id = s.product_id",
    both_="SELECT 'branch' AS scope, branch_id, product_id, CAST(on_hand AS BIGINT) AS on_hand, CAST(units AS BIGINT) AS units, CAST(revenue_cents AS BIGINT) AS revenue_cents FROM known UNION ALL SELECT 'overall', NULL, product_id, CAST(SUM(on_hand) AS BIGINT), CAST(SUM(units) AS BIGINT), CAST(SUM(revenue_cents) AS BIGINT) FROM known GROUP BY product_id"))
def worst_of_network(spark, sf_dir):
    return planning.worst_of_network(_rates(spark, sf_dir), tables.stock_levels(spark, sf_dir))
