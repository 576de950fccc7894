"""Back-order flow over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow
from ..sources import tables
from .registry import register
from .views import using

_AGE = "CASE WHEN age_days <= 7 THEN '0-7' WHEN age_days <= 14 THEN '8-14' WHEN age_days <= 30 THEN '15-30' ELSE '30+' END"


def _both(spark, sf_dir):
    return tables.back_orders(spark, sf_dir), tables.back_order_items(spark, sf_dir)


@register(using("heads", """SELECT bo_no, branch_id, branch, status, submitted_at, closed_at, items, qty_ordered, qty_fulfilled, outstanding_qty,
    value_outstanding_cents / 100.0::DOUBLE AS value_outstanding, age_days, lead_time_days, sla_days, is_overdue FROM heads"""))
def backorder_headers(spark, sf_dir):
    return tables.back_orders(spark, sf_dir).selectExpr(
        "bo_no", "branch_id", "branch", "status", "submitted_at", "closed_at", "items", "qty_ordered", "qty_fulfilled", "outstanding_qty",
        "value_outstanding_cents / 100.0D as value_outstanding", "age_days", "lead_time_days", "sla_days", "is_overdue",
    )


@register(using("items", """SELECT bo_no, line_no, branch_id, branch, product_id, description, status, qty_ordered, qty_fulfilled, outstanding_qty, fill_status,
    value_outstanding_cents FROM items"""))
def backorder_items(spark, sf_dir):
    return tables.back_order_items(spark, sf_dir).select("bo_no", "line_no", "branch_id", "branch", "product_id", "description", "status", "qty_ordered", "qty_fulfilled", "outstanding_qty", "fill_status", "value_outstanding_cents")


@register(using("stages", "SELECT bo_no, event_id, to_stage, at_us FROM stages"))
def stage_event_log(spark, sf_dir):
    return tables.stage_events(spark, sf_dir).select("bo_no", "event_id", "to_stage", "at_us")


@register(using("lines", """SELECT doc_date, branch_id, product_id, requested_qty AS qty, 'DN_REQUEST' AS source FROM lines WHERE doc_date >= DATE '2001-08-31' - 90
    UNION ALL SELECT doc_date, branch_id, product_id, sent_qty, 'SALE' FROM lines WHERE sent_qty > 0 AND doc_date >= DATE '2001-08-31' - 90"""))
def demand_history(spark, sf_dir):
    """Requests and sales of the last 90 days one below the other."""
    recent = tables.delivery_lines(spark, sf_dir, product=False).filter(F.col("doc_date") >= F.date_sub(tables.as_of(), 90))
    keys = ("doc_date", "branch_id", "product_id")
    asked = recent.select(*keys, F.col("requested_qty").alias("qty"), F.lit("DN_REQUEST").alias("source"))
    return asked.unionByName(recent.filter("sent_qty > 0").select(*keys, F.col("sent_qty").alias("qty"), F.lit("SALE").alias("source")))


@register(using("lines", """SELECT doc_date, branch_id, product_id, sent_qty AS qty, COALESCE(price_cents, 0) AS price_cents, sent_qty * COALESCE(price_cents, 0) AS value_cents
    FROM lines WHERE sent_qty > 0 AND doc_date >= DATE '2001-08-31' - 180"""))
def sales_records(spark, sf_dir):
    sold = tables.delivery_lines(spark, sf_dir).filter((F.col("sent_qty") > 0) & (F.col("doc_date") >= F.date_sub(tables.as_of(), 180)))
    price = F.coalesce("price_cents", F.lit(0).cast("long"))
    return sold.select("doc_date", "branch_id", "product_id", F.col("sent_qty").alias("qty"), price.alias("price_cents"), (F.col("sent_qty") * price).alias("value_cents"))


@register(using("heads", """SELECT h.*, i.*, round_even(CASE WHEN qty_ordered > 0 THEN qty_fulfilled::DOUBLE / qty_ordered ELSE 0 END, 4) AS fulfilment_rate FROM (
    SELECT COUNT(*) AS orders, COUNT(*) FILTER (status = 'OPEN') AS open_orders, COUNT(*) FILTER (status = 'CLOSED') AS closed_orders,
    COUNT(*) FILTER (is_overdue) AS overdue_orders, CAST(SUM(qty_ordered) AS BIGINT) AS qty_ordered, CAST(SUM(qty_fulfilled) AS BIGINT) AS qty_fulfilled,
    round_even(SUM(lead_time_days)::DOUBLE / COUNT(*) FILTER (status = 'CLOSED'), 2) AS mean_lead_days, CAST(MEDIAN(lead_time_days) AS DOUBLE) AS median_lead_days,
    round_even(COUNT(*) FILTER (lead_time_days <= sla_days)::DOUBLE / COUNT(*) FILTER (status = 'CLOSED'), 4) AS on_time_rate FROM heads) h,
    (SELECT COUNT(*) AS items, COUNT(*) FILTER (fill_status = 'FULL') AS full_items, COUNT(*) FILTER (fill_status = 'PARTIAL') AS partial_items,
    COUNT(*) FILTER (fill_status = 'NIL') AS nil_items, CAST(SUM(outstanding_qty) AS BIGINT) AS outstanding_qty,
    CAST(SUM(value_outstanding_cents) AS BIGINT) AS value_outstanding_cents FROM items) i"""))
def flow_metrics(spark, sf_dir):
    return flow.metrics(*_both(spark, sf_dir))


@register(using("heads", """SELECT s.ord, s.stage, COALESCE(orders, 0) AS orders, COALESCE(outstanding_qty, 0) AS outstanding_qty
    FROM (VALUES (0, 'OPEN'), (1, 'CLOSED')) s(ord, stage) LEFT JOIN (SELECT stage, COUNT(*) AS orders, CAST(SUM(outstanding_qty) AS BIGINT) AS outstanding_qty
    FROM heads GROUP BY stage) g ON s.stage = g.stage"""))
def stage_funnel(spark, sf_dir):
    return flow.stage_funnel(tables.back_orders(spark, sf_dir, product=False), ("OPEN", "CLOSED"))


_DURATIONS = """SELECT *, next_us - at_us AS micros FROM (
    SELECT *, LEAD(at_us) OVER (PARTITION BY bo_no ORDER BY at_us, event_id) AS next_us FROM stages) WHERE next_us IS NOT NULL"""
_CYCLES = """SELECT to_stage, COUNT(*) AS transitions, round_even(SUM(micros)::DOUBLE / COUNT(*) / 86400000000, 2) AS mean_days,
    round_even(quantile_cont(micros / 86400000000::DOUBLE, 0.5), 2) AS median_days, round_even(quantile_cont(micros / 86400000000::DOUBLE, 0.9), 2) AS p90_days
    FROM d GROUP BY to_stage"""


@register(using("stages", "SELECT bo_no, event_id, to_stage, at_us, next_us, micros FROM d", d=_DURATIONS))
def stage_durations(spark, sf_dir):
    return flow.stage_durations(tables.stage_events(spark, sf_dir)).select("bo_no", "event_id", "to_stage", "at_us", "next_us", "micros")


@register(using("stages", _CYCLES, d=_DURATIONS))
def cycle_times(spark, sf_dir):
    return flow.cycle_times(tables.stage_events(spark, sf_dir))


@register(using("stages", f"SELECT to_stage, mean_days FROM ({_CYCLES}) ORDER BY mean_days DESC, to_stage LIMIT 1", d=_DURATIONS))
def bottleneck_stage(spark, sf_dir):
    return flow.bottleneck(tables.stage_events(spark, sf_dir))


@register(using("heads", f"""SELECT b.bucket, COALESCE(orders, 0) AS orders, COALESCE(outstanding_qty, 0) AS outstanding_qty
    FROM (VALUES ('0-7'), ('8-14'), ('15-30'), ('30+')) b(bucket) LEFT JOIN (SELECT {_AGE} AS bucket, COUNT(*) AS orders,
    CAST(SUM(outstanding_qty) AS BIGINT) AS outstanding_qty FROM heads WHERE status = 'OPEN' GROUP BY 1) g ON b.bucket = g.bucket"""))
def open_order_ageing(spark, sf_dir):
    return flow.ageing(tables.back_orders(spark, sf_dir, product=False))


@register(using("heads", f"""SELECT stage, COUNT(*) FILTER (b = '0-7') AS d0_7, COUNT(*) FILTER (b = '8-14') AS d8_14, COUNT(*) FILTER (b = '15-30') AS d15_30,
    COUNT(*) FILTER (b = '30+') AS d30_plus FROM (SELECT stage, {_AGE} AS b FROM heads) GROUP BY stage"""))
def ageing_by_stage(spark, sf_dir):
    return flow.ageing_by_group(tables.back_orders(spark, sf_dir, product=False), "stage")


@register(using("heads", """SELECT h.*, COALESCE(i.qty_ordered, 0) AS qty_ordered, COALESCE(i.qty_fulfilled, 0) AS qty_fulfilled, COALESCE(i.outstanding_qty, 0) AS outstanding_qty,
    round_even(CASE WHEN i.qty_ordered > 0 THEN i.qty_fulfilled::DOUBLE / i.qty_ordered ELSE 0 END, 4) AS fulfilment_rate FROM (
    SELECT branch_id, branch, COUNT(*) AS orders, COUNT(*) FILTER (status = 'OPEN') AS open_orders, COUNT(*) FILTER (is_overdue) AS overdue_orders,
    COALESCE(round_even(SUM(lead_time_days)::DOUBLE / COUNT(lead_time_days), 1), 0) AS mean_lead_days FROM heads GROUP BY branch_id, branch) h
    LEFT JOIN (SELECT branch_id, CAST(SUM(qty_ordered) AS BIGINT) AS qty_ordered, CAST(SUM(qty_fulfilled) AS BIGINT) AS qty_fulfilled,
    CAST(SUM(outstanding_qty) AS BIGINT) AS outstanding_qty FROM items GROUP BY branch_id) i ON h.branch_id = i.branch_id"""))
def flow_by_branch(spark, sf_dir):
    return flow.by_branch(tables.back_orders(spark, sf_dir, product=False), tables.back_order_items(spark, sf_dir, product=False))


@register(using("items", """SELECT product_id, description, COUNT(DISTINCT bo_no) AS orders, CAST(SUM(qty_ordered) AS BIGINT) AS qty_ordered,
    CAST(SUM(outstanding_qty) AS BIGINT) AS outstanding_qty, CAST(SUM(value_outstanding_cents) AS BIGINT) AS value_outstanding_cents
    FROM items GROUP BY product_id, description ORDER BY outstanding_qty DESC, product_id LIMIT 20"""))
def flow_top_items(spark, sf_dir):
    return flow.top_items(tables.back_order_items(spark, sf_dir))


@register(using("items", """SELECT branch_id, sold, short, round_even(sold / 13.0::DOUBLE, 2) AS sold_per_week, round_even(short / 13.0::DOUBLE, 2) AS short_per_week,
    CASE WHEN sold + short > 0 THEN round_even(sold::DOUBLE / (sold + short), 3) END AS demand_met, CASE WHEN sold > 0 THEN round_even(short::DOUBLE / sold, 3) END AS short_to_sales
    FROM (SELECT COALESCE(s.branch_id, q.branch_id) AS branch_id, COALESCE(sold, 0) AS sold, COALESCE(short, 0) AS short FROM
    (SELECT branch_id, CAST(SUM(sent_qty) AS BIGINT) AS sold FROM lines WHERE doc_date >= DATE '2001-08-31' - 91 GROUP BY 1) s FULL JOIN
    (SELECT branch_id, CAST(SUM(qty_ordered) AS BIGINT) AS short FROM items WHERE doc_date >= DATE '2001-08-31' - 91 GROUP BY 1) q ON s.branch_id = q.branch_id)"""))
def backorders_against_sales(spark, sf_dir):
    return flow.orders_against_sales(tables.delivery_lines(spark, sf_dir, product=False), tables.back_order_items(spark, sf_dir, product=False), tables.as_of())


@register(using("heads", """SELECT c.week, COALESCE(raised, 0) AS raised, COALESCE(closed, 0) AS closed,
    CAST(SUM(COALESCE(raised, 0) - COALESCE(closed, 0)) OVER (ORDER BY c.week) AS BIGINT) AS outstanding
    FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week FROM
      (SELECT MIN(week) AS lo, MAX(week) AS hi FROM (SELECT week FROM r UNION ALL SELECT week FROM k))) c
    LEFT JOIN r ON c.week = r.week LEFT JOIN k ON c.week = k.week""",
    r="SELECT CAST(date_trunc('week', submitted_at) + INTERVAL 6 DAY AS DATE) AS week, COUNT(*) AS raised FROM heads GROUP BY 1",
    k="SELECT CAST(date_trunc('week', closed_at) + INTERVAL 6 DAY AS DATE) AS week, COUNT(*) AS closed FROM heads WHERE closed_at IS NOT NULL GROUP BY 1"))
def weekly_order_flow(spark, sf_dir):
    return flow.weekly_flow(tables.back_orders(spark, sf_dir, product=False))


@register(using("lines", """SELECT doc_date, sent_qty, round_even(SUM(sent_qty) OVER w::DOUBLE / COUNT(*) OVER w, 4) AS moving_average FROM
    (SELECT doc_date, CAST(SUM(sent_qty) AS BIGINT) AS sent_qty FROM lines GROUP BY doc_date) WINDOW w AS (ORDER BY doc_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""))
def daily_sales_average(spark, sf_dir):
    return flow.daily_average(tables.delivery_lines(spark, sf_dir, product=False))


@register(using("heads", """SELECT CAST(LEAST(FLOOR((lead_time_days - lo) * bins / GREATEST(hi - lo, 1)), bins - 1) AS BIGINT) AS bin, COUNT(*) AS orders,
    MIN(lead_time_days) AS least_days, MAX(lead_time_days) AS most_days FROM heads,
    (SELECT MIN(lead_time_days) AS lo, MAX(lead_time_days) AS hi, LEAST(COUNT(lead_time_days), 20)::DOUBLE AS bins FROM heads)
    WHERE lead_time_days IS NOT NULL GROUP BY 1"""))
def lead_time_histogram(spark, sf_dir):
    return flow.lead_histogram(tables.back_orders(spark, sf_dir, product=False))


_CELLS = ", ".join(f"CAST(COALESCE(SUM(outstanding_qty) FILTER (branch_id = {b}), 0) AS BIGINT) AS b{b}" for b in range(25))


@register(using("items", f"""SELECT product_id, {_CELLS} FROM items WHERE product_id IN (SELECT product_id FROM items GROUP BY product_id
    ORDER BY SUM(outstanding_qty) DESC, product_id LIMIT 20) GROUP BY product_id"""))
def branch_item_heatmap(spark, sf_dir):
    return flow.branch_item_heatmap(tables.back_order_items(spark, sf_dir, product=False), tuple(range(25)))


_PERFORMANCE = """SELECT * EXCLUDE (n_lines, nil_lines, bo_fulfilled, lead_sum, leads), CASE WHEN requested_qty = 0 AND bo_incidents = 0 THEN 'No demand signal'
      WHEN (fill_rate < 0.6 OR unmet_demand_ratio > 0.4 OR stockout_line_pct > 0.3) AND bo_incidents >= 3 THEN 'Chronic shortage'
      WHEN fill_rate < 0.6 OR unmet_demand_ratio > 0.4 OR stockout_line_pct > 0.3 THEN 'Supply-constrained'
      WHEN COALESCE(fill_rate >= 0.9, true) AND bo_incidents = 0 AND sold_qty <= 5 THEN 'Genuinely low demand' ELSE 'Healthy' END AS verdict FROM (
    SELECT *, CASE WHEN requested_qty > 0 THEN round_even(sent_qty::DOUBLE / requested_qty, 3) END AS fill_rate,
      CASE WHEN requested_qty > 0 THEN round_even(GREATEST(requested_qty - sent_qty, 0)::DOUBLE / requested_qty, 3) END AS unmet_demand_ratio,
      CASE WHEN n_lines > 0 THEN round_even(nil_lines::DOUBLE / n_lines, 3) END AS stockout_line_pct, CASE WHEN bo_qty > 0 THEN round_even(bo_fulfilled::DOUBLE / bo_qty, 3) END AS recovery_rate,
      CASE WHEN leads > 0 THEN round_even(lead_sum::DOUBLE / leads, 1) END AS avg_wait_days, CASE WHEN sold_qty + bo_qty > 0 THEN round_even(sold_qty::DOUBLE / (sold_qty + bo_qty), 3) END AS demand_captured_pct FROM (
    SELECT p.product_id, COALESCE(f.description, CAST(p.product_id AS VARCHAR)) AS description, f.category, COALESCE(sold_qty, 0) AS sold_qty, COALESCE(sold_cents, 0) AS sold_cents, COALESCE(requested_qty, 0) AS requested_qty,
      COALESCE(sent_qty, 0) AS sent_qty, COALESCE(n_lines, 0) AS n_lines, COALESCE(nil_lines, 0) AS nil_lines, COALESCE(bo_incidents, 0) AS bo_incidents, COALESCE(bo_qty, 0) AS bo_qty, COALESCE(bo_fulfilled, 0) AS bo_fulfilled,
      COALESCE(bo_outstanding_qty, 0) AS bo_outstanding_qty, COALESCE(lost_sales_cents, 0) AS lost_sales_cents, lead_sum, leads
    FROM (SELECT DISTINCT product_id FROM lines WHERE backorder_qty > 0 OR doc_date >= DATE '2001-08-31' - 90 OR date_trunc('month', doc_date) IN (SELECT m FROM months)) p
    LEFT JOIN (SELECT product_id, CAST(SUM(sent_qty) AS BIGINT) AS sold_qty, CAST(SUM(sent_qty * price_cents) AS BIGINT) AS sold_cents FROM lines WHERE date_trunc('month', doc_date) IN (SELECT m FROM months) GROUP BY 1) s
      ON p.product_id = s.product_id
    LEFT JOIN (SELECT product_id, CAST(SUM(requested_qty) AS BIGINT) AS requested_qty, CAST(SUM(sent_qty) AS BIGINT) AS sent_qty, COUNT(*) AS n_lines, COUNT(*) FILTER (fill_status = 'NIL') AS nil_lines,
      MAX(description) AS description, MAX(category) AS category FROM lines WHERE doc_date >= DATE '2001-08-31' - 90 GROUP BY 1) f ON p.product_id = f.product_id
    LEFT JOIN (SELECT product_id, COUNT(DISTINCT i.bo_no) AS bo_incidents, CAST(SUM(i.qty_ordered) AS BIGINT) AS bo_qty, CAST(SUM(i.qty_fulfilled) AS BIGINT) AS bo_fulfilled,
      CAST(SUM(i.outstanding_qty) AS BIGINT) AS bo_outstanding_qty, CAST(SUM(i.value_outstanding_cents) AS BIGINT) AS lost_sales_cents, SUM(lead_time_days) AS lead_sum, COUNT(lead_time_days) AS leads
      FROM items i JOIN heads h ON i.bo_no = h.bo_no GROUP BY 1) b ON p.product_id = b.product_id))"""
_MONTHS = "SELECT DISTINCT date_trunc('month', doc_date) AS m FROM lines ORDER BY m DESC LIMIT 3"


def _performance(spark, sf_dir):
    return flow.product_performance(tables.delivery_lines(spark, sf_dir), tables.back_order_items(spark, sf_dir), tables.as_of())


@register(using("heads", _PERFORMANCE, months=_MONTHS))
def product_performance(spark, sf_dir):
    return _performance(spark, sf_dir)


@register(using("heads", f"""SELECT COUNT(*) AS products, COUNT(*) FILTER (verdict = 'Supply-constrained') AS supply_constrained, COUNT(*) FILTER (verdict = 'Chronic shortage') AS chronic_shortage,
    COUNT(*) FILTER (verdict = 'Genuinely low demand') AS genuinely_low_demand, COUNT(*) FILTER (stockout_line_pct > 0) AS products_with_stockout, CAST(SUM(lost_sales_cents) AS BIGINT) AS lost_sales_cents,
    round_even(MEDIAN(fill_rate), 3) AS median_fill_rate FROM ({_PERFORMANCE})""", months=_MONTHS))
def performance_kpis(spark, sf_dir):
    return flow.performance_kpis(_performance(spark, sf_dir))


_RATES = """SELECT branch_id, product_id, CAST(CEIL(SUM(requested_qty) / 26.0::DOUBLE) AS BIGINT) AS predicted,
    CAST(COALESCE(SUM(sent_qty) FILTER (doc_date >= DATE '2001-08-31' - 91), 0) AS BIGINT) AS actual
    FROM lines WHERE doc_date >= DATE '2001-08-31' - 182 GROUP BY branch_id, product_id"""


@register(using("items stock", """SELECT r.branch_id, r.product_id, predicted, actual, predicted - actual AS shortfall, COALESCE(backordered, 0) AS backordered, COALESCE(on_hand, 0) AS on_hand,
    CASE WHEN COALESCE(backordered, 0) > 0 THEN 'Stockout, back ordered' WHEN COALESCE(on_hand, 0) <= 0 THEN 'No stock, no back order' ELSE 'Low demand, stock available' END AS cause
    FROM rates r LEFT JOIN (SELECT branch_id, product_id, CAST(SUM(qty_ordered - qty_fulfilled) AS BIGINT) AS backordered FROM items WHERE status = 'OPEN' GROUP BY 1, 2) o
      ON r.branch_id = o.branch_id AND r.product_id = o.product_id LEFT JOIN stock s ON r.branch_id = s.branch_id AND r.product_id = s.product_id
    WHERE predicted >= 3 AND actual < predicted * (1 - 0.4::DOUBLE)""", rates=_RATES))
def low_sales_diagnosis(spark, sf_dir):
    """Half-year request rate against the last quarter's sales."""
    lines = tables.delivery_lines(spark, sf_dir, product=False).filter(F.col("doc_date") >= F.date_sub(tables.as_of(), 182))
    recent = F.when(F.col("doc_date") >= F.date_sub(tables.as_of(), 91), F.col("sent_qty"))
    rates = lines.groupBy("branch_id", "product_id").agg(F.ceil(F.sum("requested_qty") / 26).alias("predicted"), F.coalesce(F.sum(recent), F.lit(0).cast("long")).alias("actual"))
    return flow.low_sales(rates, tables.stock_levels(spark, sf_dir), tables.back_order_items(spark, sf_dir, product=False))
