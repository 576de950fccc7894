"""Delivery-note fill over the whole lineitem table."""

from __future__ import annotations

from ..operators import fill
from ..sources.tables import delivery_lines
from .registry import register
from .views import using

_SUMS = """COUNT(*) AS lines, CAST(SUM(requested_qty) AS BIGINT) AS requested_qty, CAST(SUM(sent_qty) AS BIGINT) AS sent_qty,
    CAST(SUM(backorder_qty) AS BIGINT) AS backorder_qty"""
_RATE = "round_even(CASE WHEN SUM(requested_qty) > 0 THEN SUM(sent_qty)::DOUBLE / SUM(requested_qty) ELSE 0 END, 4) AS fill_rate"
_LINE_RATE = "round_even(COUNT(*) FILTER (fill_status = 'FULL')::DOUBLE / COUNT(*), 4) AS line_fill_rate"


@register(using("lines", """SELECT dn_no, line_no, doc_date, branch_id, branch, product_id, description, category, requested_qty, sent_qty,
    backorder_qty, fill_status, price_cents / 100.0::DOUBLE AS unit_price, backorder_cents / 100.0::DOUBLE AS backorder_value, age_days FROM lines"""))
def delivery_note_lines(spark, sf_dir):
    return delivery_lines(spark, sf_dir).selectExpr(
        "dn_no", "line_no", "doc_date", "branch_id", "branch", "product_id", "description", "category", "requested_qty", "sent_qty", "backorder_qty", "fill_status",
        "price_cents / 100.0D as unit_price", "backorder_cents / 100.0D as backorder_value", "age_days",
    )


@register(using("lines", f"""SELECT COUNT(DISTINCT dn_no) AS documents, COUNT(DISTINCT branch_id) AS branches, COUNT(DISTINCT product_id) AS products,
    {_SUMS}, COUNT(*) FILTER (backorder_qty > 0) AS backordered_lines, COUNT(*) FILTER (fill_status = 'FULL') AS full_lines,
    COUNT(*) FILTER (fill_status = 'PARTIAL') AS partial_lines, COUNT(*) FILTER (fill_status = 'NIL') AS nil_lines,
    SUM(backorder_cents)::DOUBLE / 100 AS value, {_RATE}, {_LINE_RATE} FROM lines"""))
def fill_overall(spark, sf_dir):
    return fill.overall(delivery_lines(spark, sf_dir))


@register(using("lines", f"""SELECT s.fill_status, COALESCE(lines, 0) AS lines, COALESCE(requested_qty, 0) AS requested_qty, COALESCE(sent_qty, 0) AS sent_qty,
    COALESCE(backorder_qty, 0) AS backorder_qty, round_even(COALESCE(lines, 0) * 100.0::DOUBLE / (SELECT COUNT(*) FROM lines), 1) AS pct_of_lines
    FROM (VALUES ('FULL'), ('PARTIAL'), ('NIL')) s(fill_status)
    LEFT JOIN (SELECT fill_status, {_SUMS} FROM lines GROUP BY fill_status) g ON s.fill_status = g.fill_status"""))
def fill_by_status(spark, sf_dir):
    return fill.by_status(delivery_lines(spark, sf_dir))


@register(using("lines", f"""SELECT branch_id, branch, {_SUMS}, COUNT(*) FILTER (backorder_qty > 0) AS backordered_lines,
    COUNT(*) FILTER (fill_status = 'NIL') AS nil_lines, MAX(age_days) AS oldest_days, {_RATE}, {_LINE_RATE} FROM lines GROUP BY branch_id, branch"""))
def fill_by_branch(spark, sf_dir):
    return fill.by_branch(delivery_lines(spark, sf_dir))


@register(using("lines", f"""SELECT product_id, description, {_SUMS}, COUNT(DISTINCT dn_no) AS documents, COUNT(DISTINCT branch_id) AS branches, {_RATE}
    FROM lines WHERE description IS NOT NULL GROUP BY product_id, description"""))
def fill_by_item(spark, sf_dir):
    return fill.by_item(delivery_lines(spark, sf_dir))


@register(using("lines", f"""SELECT product_id, description, {_SUMS}, COUNT(DISTINCT dn_no) AS documents, COUNT(DISTINCT branch_id) AS branches, {_RATE}
    FROM lines WHERE description IS NOT NULL GROUP BY product_id, description ORDER BY backorder_qty DESC, product_id LIMIT 20"""))
def fill_top_items(spark, sf_dir):
    return fill.by_item(delivery_lines(spark, sf_dir), 20)


@register(using("lines", f"""SELECT COALESCE(category, '(uncategorised)') AS category, {_SUMS}, COUNT(*) FILTER (fill_status = 'NIL') AS nil_lines, {_RATE}
    FROM lines GROUP BY COALESCE(category, '(uncategorised)')"""))
def fill_by_category(spark, sf_dir):
    return fill.by_category(delivery_lines(spark, sf_dir))


@register(using("lines", """SELECT b.bucket, COALESCE(lines, 0) AS lines, COALESCE(backorder_qty, 0) AS backorder_qty
    FROM (VALUES ('0-7'), ('8-14'), ('15-30'), ('30+')) b(bucket) LEFT JOIN (
      SELECT CASE WHEN age_days <= 7 THEN '0-7' WHEN age_days <= 14 THEN '8-14' WHEN age_days <= 30 THEN '15-30' ELSE '30+' END AS bucket,
      COUNT(*) AS lines, CAST(SUM(backorder_qty) AS BIGINT) AS backorder_qty FROM lines WHERE backorder_qty > 0 GROUP BY 1) g ON b.bucket = g.bucket"""))
def fill_ageing(spark, sf_dir):
    return fill.ageing(delivery_lines(spark, sf_dir))


@register(using("lines", f"""SELECT CAST(date_trunc('week', doc_date) + INTERVAL 6 DAY AS DATE) AS week_ending, {_SUMS}, {_RATE}
    FROM lines GROUP BY 1 HAVING SUM(requested_qty) > 0"""))
def fill_weekly_trend(spark, sf_dir):
    return fill.weekly_trend(delivery_lines(spark, sf_dir))


@register(using("lines", """SELECT product_id, description, COUNT(DISTINCT dn_no) AS occurrences, COUNT(DISTINCT branch_id) AS branches,
    CAST(SUM(backorder_qty) AS BIGINT) AS backorder_qty FROM lines WHERE backorder_qty > 0 AND description IS NOT NULL
    GROUP BY product_id, description HAVING COUNT(DISTINCT dn_no) >= 2"""))
def fill_recurring(spark, sf_dir):
    return fill.recurring(delivery_lines(spark, sf_dir))
