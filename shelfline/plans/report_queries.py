"""Lists, filters, key figures and bundles over the whole tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import fill, flow, forecast, panel, recode, reports, sales
from ..sources import tables
from .allocation_queries import _BEST, _CODES, _FOUND, _LIFE, _codes, allocation_split
from .forecast_queries import MONTHLY_SQL
from .panel_queries import dense_sql
from . import flow_queries  # noqa: F401 (its SQL is part of the bundle's)
from .registry import oracle_of, register
from .views import using


@register(using("items", """SELECT bo_no, line_no, branch_id, description, status, qty_ordered FROM items WHERE status = 'OPEN' AND doc_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'
    AND (contains(lower(description), 'bolt') OR contains(lower(branch), 'bolt'))"""))
def searched_back_orders(spark, sf_dir):
    """Open items of three years whose product or branch has a word."""
    rows = reports.picked(tables.back_order_items(spark, sf_dir), {"status": "OPEN", "branch_id": None}, {"doc_date": (datetime.date(1997, 1, 1), datetime.date(1999, 12, 31))}, "BOLT", ("description", "branch"))
    return rows.select("bo_no", "line_no", "branch_id", "description", "status", "qty_ordered")


@register(using("dn", """SELECT 'exact' AS kind, branch, COUNT(*) AS notes FROM (SELECT DISTINCT dn_no, branch FROM dn) WHERE branch = 'NATION_1' GROUP BY branch UNION ALL
    SELECT 'prefix', branch, COUNT(*) FROM (SELECT DISTINCT dn_no, branch FROM dn) WHERE branch LIKE 'NATION!_2%' ESCAPE '!' GROUP BY branch UNION ALL
    SELECT 'either', branch, COUNT(*) FROM (SELECT DISTINCT dn_no, branch FROM dn) WHERE branch LIKE 'NATION!_1%' ESCAPE '!' GROUP BY branch"""))
def notes_of_branch(spark, sf_dir):
    """By a code that is one, by the beginning of names, and by either at once."""
    notes = tables.delivery_lines(spark, sf_dir, product=False).select("dn_no", "branch", F.concat(F.lit("NATION_"), F.col("branch_id").cast("string")).alias("branch_code")).distinct()
    found = [("exact", reports.of_branch(notes, " nation_1 ")), ("prefix", reports.of_branch(notes.withColumn("branch_code", F.lit("x")), "nation_2")), ("either", reports.of_branch_or_prefix(notes, "nation_1"))]
    first, *others = [f.groupBy("branch").agg(F.count(F.lit(1)).alias("notes")).select(F.lit(kind).alias("kind"), "branch", "notes") for kind, f in found]
    for other in others:
        first = first.unionByName(other)
    return first


@register(using("panel", """SELECT branch, period, CAST(COALESCE(SUM(qty) FILTER (contains(lower(sku), 'd#1')), 0) AS BIGINT) AS qty, CAST(COALESCE(SUM(turnover_cents) FILTER (contains(lower(sku), 'd#1')), 0) AS BIGINT) AS turnover_cents
    FROM (SELECT * FROM panel UNION ALL SELECT b.branch, NULL, c.period, 0, 0 FROM (SELECT DISTINCT branch FROM panel WHERE contains(lower(sku), 'd#1')) b, (SELECT CAST(unnest(generate_series(MIN(period), MAX(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM panel) c)
    WHERE branch IN (SELECT branch FROM panel WHERE contains(lower(sku), 'd#1')) GROUP BY ALL"""))
def searched_sales_series(spark, sf_dir):
    """Series of the items whose name has a text, taken as it is."""
    return sales.series(tables.monthly_panel(spark, sf_dir), query="D#1")


@register(using("panel", """SELECT sku, CAST(SUM(qty) AS BIGINT) AS qty, strftime(DATE '1998-03-01', '%b %Y') || ' - ' || strftime(DATE '1998-08-01', '%b %Y') AS label FROM panel WHERE period BETWEEN DATE '1998-03-01' AND DATE '1998-08-31' GROUP BY sku"""))
def period_range_sales(spark, sf_dir):
    rows = reports.period_window(tables.monthly_panel(spark, sf_dir), 3, datetime.date(1998, 3, 1), datetime.date(1998, 8, 31))
    return rows.groupBy("sku", "label").agg(F.sum("qty").alias("qty"))


@register(using("panel", """SELECT branch, sku, CAST(COALESCE(SUM(qty) FILTER (period = DATE '1999-01-01'), 0) AS BIGINT) AS m_199901, CAST(COALESCE(SUM(qty) FILTER (period = DATE '1999-02-01'), 0) AS BIGINT) AS m_199902,
    CAST(COALESCE(SUM(qty) FILTER (period = DATE '1999-03-01'), 0) AS BIGINT) AS m_199903 FROM panel GROUP BY branch, sku"""))
def month_columns(spark, sf_dir):
    return reports.month_columns(tables.monthly_panel(spark, sf_dir), [datetime.date(1999, m, 1) for m in (1, 2, 3)])


@register(using("heads lines", """SELECT unnest(['orders', 'open_orders', 'overdue_orders', 'outstanding_qty', 'documents', 'lines', 'backorder_qty', 'units_90']) AS metric, unnest([orders, open_orders, overdue_orders, outstanding_qty, documents, n_lines, backorder_qty, units_90]::DOUBLE[]) AS value FROM
    (SELECT COUNT(*) AS orders, COUNT(*) FILTER (status = 'OPEN') AS open_orders, COUNT(*) FILTER (is_overdue) AS overdue_orders, SUM(outstanding_qty) AS outstanding_qty FROM heads),
    (SELECT COUNT(DISTINCT dn_no) AS documents, COUNT(*) AS n_lines, SUM(backorder_qty) AS backorder_qty FROM lines), (SELECT SUM(sent_qty) AS units_90 FROM lines WHERE doc_date >= DATE '2001-08-31' - 90)"""))
def overall_kpis(spark, sf_dir):
    """Key figures of back orders, fill and sales as rows."""
    return _kpis(spark, sf_dir)


def _kpis(spark, sf_dir, branch=None):
    only = {"branch": branch}
    orders, items, lines = (reports.picked(f(spark, sf_dir), only) for f in (tables.back_orders, tables.back_order_items, tables.delivery_lines))
    bo = flow.metrics(orders, items).select("orders", "open_orders", "overdue_orders", "outstanding_qty")
    sold = lines.filter(F.col("doc_date") >= F.date_sub(tables.as_of(), 90)).agg(F.sum("sent_qty").alias("units_90"))
    return reports.as_metrics(reports.side_by_side(bo, fill.overall(lines).select("documents", "lines", "backorder_qty"), sold))


@register(using("stock", "SELECT COUNT(DISTINCT branch_id) AS branches, COUNT(*) AS rows, array_to_string(list_sort(list(DISTINCT CAST(branch_id AS VARCHAR))), ', ') AS branch_codes FROM stock"))
def stock_coverage(spark, sf_dir):
    return reports.stock_coverage(tables.stock_levels(spark, sf_dir))


@register(using("stock", "SELECT branch_id, COUNT(DISTINCT product_id) AS skus, CAST(SUM(on_hand) AS BIGINT) AS units FROM stock GROUP BY branch_id"))
def stock_summary(spark, sf_dir):
    return reports.stock_summary(tables.stock_levels(spark, sf_dir))


@register(using("stock", "SELECT branch_id, product_id, CASE WHEN branch_id IN (3, 5) THEN 0 ELSE on_hand END AS on_hand FROM stock"))
def trusted_stock(spark, sf_dir):
    return reports.trusted_stock(tables.stock_levels(spark, sf_dir), [3, 5]).select("branch_id", "product_id", "on_hand")


@register(using("heads", """SELECT bo_no, branch_id, outstanding_qty, (SELECT COUNT(*) FROM heads WHERE status = 'OPEN') AS total FROM heads WHERE status = 'OPEN' ORDER BY outstanding_qty DESC, bo_no LIMIT 50"""))
def largest_open_orders(spark, sf_dir):
    rows = tables.back_orders(spark, sf_dir, product=False).filter("status = 'OPEN'").select("bo_no", "branch_id", "outstanding_qty")
    return reports.top_by(rows, "outstanding_qty", 50, "bo_no")


@register(using("panel", """SELECT sku AS item, qty AS units, place, items, round_even(qty * 100.0::DOUBLE / total, 1) AS pct FROM (SELECT sku, qty, ROW_NUMBER() OVER (ORDER BY qty DESC, sku) AS place, COUNT(*) OVER () AS items, SUM(qty) OVER () AS total FROM (
    SELECT sku, CAST(SUM(qty) AS BIGINT) AS qty FROM (SELECT branch, sku, SUM(qty) AS qty FROM panel WHERE period IN (SELECT DISTINCT period FROM panel ORDER BY period DESC LIMIT 12) GROUP BY ALL HAVING SUM(qty) > 0) GROUP BY sku)) WHERE sku IN ('Brand#1', 'Brand#12', 'Brand#25')"""))
def compared_items(spark, sf_dir):
    return reports.mix_of(tables.monthly_panel(spark, sf_dir), ["Brand#1", "Brand#12", "Brand#25"])


_VALUED = """SELECT m.*, round_even(COALESCE(m.point * price, 0) + 1e-6::DOUBLE, 2) AS value_cents FROM monthly m
    LEFT JOIN (SELECT branch, sku, CASE WHEN SUM(qty) > 0 THEN SUM(turnover_cents)::DOUBLE / SUM(qty) END AS price FROM fine GROUP BY branch, sku) p ON p.branch = m.branch AND p.sku = m.sku"""
_TOLD = {"dense": dense_sql("fine"), "monthly": MONTHLY_SQL, "valued": _VALUED}


def _valued(spark, sf_dir):
    history = tables.monthly_panel(spark, sf_dir, "branch")
    series = panel.as_arrays(panel.densify(history))
    return reports.forecast_values(forecast.monthly_forecast(series.withColumn("y", panel.tail(F.col("y"), 6))), history)


@register(using("fine", "SELECT branch, COUNT(*) AS series, " + ", ".join(f"COUNT(*) FILTER (pattern = '{p}') AS {p}" for p in ("growing", "declining", "intermittent", "new", "dropped"))
    + ", " + ", ".join(f"COUNT(*) FILTER (confidence = '{c}') AS {c.lower()}" for c in ("High", "Medium", "Low")) + ", round_even(SUM(point), 2) AS units, round_even(SUM(value_cents), 0) AS value_cents FROM valued GROUP BY branch", **_TOLD))
def forecast_summary(spark, sf_dir):
    return reports.forecast_summary(_valued(spark, sf_dir))


@register(using("fine", "SELECT branch, sku, pattern, point, value_cents, confidence, (SELECT COUNT(*) FROM valued) AS total FROM valued ORDER BY value_cents DESC, branch, sku LIMIT 20", **_TOLD))
def forecast_top_by_value(spark, sf_dir):
    rows = _valued(spark, sf_dir).select("branch", "sku", "pattern", "point", "value_cents", "confidence")
    return reports.top_by(rows, "value_cents", 20, "branch", "sku")


@register(using("dn", "SELECT 'month' AS scale, CASE WHEN hi > lo THEN GREATEST(1, round_even(56.0::DOUBLE * (n - 1) / (hi - lo), 0)) ELSE 8 END::INTEGER AS \"limit\" FROM (SELECT COUNT(DISTINCT p) AS n, MIN(p) AS lo, MAX(p) AS hi FROM (SELECT CAST(date_trunc('month', doc_date) AS DATE) AS p FROM dn))"
    " UNION ALL SELECT 'week', CASE WHEN hi > lo THEN GREATEST(1, round_even(56.0::DOUBLE * (n - 1) / (hi - lo), 0)) ELSE 8 END::INTEGER FROM (SELECT COUNT(DISTINCT p) AS n, MIN(p) AS lo, MAX(p) AS hi FROM (SELECT CAST(date_trunc('week', doc_date) AS DATE) AS p FROM dn))"))
def dry_run_limits(spark, sf_dir):
    """How long a dry spell may be in months and in weeks."""
    notes = tables.delivery_lines(spark, sf_dir, product=False)
    month, week = (panel.dry_run_limit(notes.select(F.date_trunc(scale, "doc_date").cast("date").alias("period"))).select(F.lit(scale).alias("scale"), "limit") for scale in ("month", "week"))
    return month.unionByName(week)


@register(using("dn", """SELECT branch, sku, CAST(COALESCE(SUM(qty) FILTER (back = 3), 0) AS BIGINT) AS q1, CAST(COALESCE(SUM(qty) FILTER (back = 2), 0) AS BIGINT) AS q2, CAST(COALESCE(SUM(qty) FILTER (back = 1), 0) AS BIGINT) AS q3, any_value(item) AS item, any_value(category) AS category,
    CASE WHEN SUM(qty) > 0 THEN round_even(SUM(turnover_cents)::DOUBLE / SUM(qty), 4) END AS unit_price_cents FROM goods JOIN (SELECT period, ROW_NUMBER() OVER (ORDER BY period DESC) AS back FROM (SELECT DISTINCT period FROM goods)) USING (period) WHERE back <= 3 GROUP BY branch, sku""",
    goods="SELECT region AS branch, product_id AS sku, description AS item, category, CAST(date_trunc('month', doc_date) AS DATE) AS period, SUM(requested_qty) AS qty, SUM(revenue_cents) AS turnover_cents FROM dn GROUP BY ALL"))
def month_matrix(spark, sf_dir):
    """The last three months of each region and product beside each other."""
    lines = tables.delivery_lines(spark, sf_dir)
    months = lines.groupBy(F.col("region").alias("branch"), F.col("product_id").alias("sku"), F.col("description").alias("item"), "category", F.trunc("doc_date", "month").alias("period"))
    return panel.matrix(months.agg(F.sum("requested_qty").alias("qty"), F.sum("revenue_cents").alias("turnover_cents")))


_LAST = "SELECT branch, old, arg_max(new, depth) AS new FROM walk GROUP BY branch, old"
_WALK = "SELECT branch, old, new, 1 AS depth FROM found UNION ALL SELECT w.branch, w.old, f.new, depth + 1 FROM walk w JOIN found f ON w.branch = f.branch AND w.new = f.old"
_RECODED = {"codes": _CODES, "life": _LIFE, "best": _BEST, "found": _FOUND, "walk": _WALK, "merges": _LAST}


def _merges(spark, sf_dir):
    codes = _codes(spark, sf_dir)
    return codes, recode.follow(recode.find_recodes(codes))


@register("WITH RECURSIVE " + using("dn", """SELECT r.branch, r.sku, r.item, r.t, CAST(SUM(qty) AS BIGINT) AS qty, CAST(SUM(turnover) AS BIGINT) AS turnover_cents, CAST(SUM(profit) AS BIGINT) AS profit_cents, CASE WHEN SUM(turnover) > 0 THEN round_even(100.0::DOUBLE * SUM(profit) / SUM(turnover), 4) END AS gp_pct FROM (
    SELECT c.branch, COALESCE(m.new, c.sku) AS sku, COALESCE(n.item, c.item) AS item, c.t, c.qty, c.turnover, CASE WHEN c.t % 5 <> 0 THEN c.qty * 3 END AS profit FROM codes c LEFT JOIN merges m ON m.branch = c.branch AND m.old = c.sku
    LEFT JOIN (SELECT branch, sku, arg_max(item, (t, item)) AS item FROM codes GROUP BY ALL) n ON n.branch = c.branch AND n.sku = m.new) r GROUP BY ALL""", **_RECODED)[5:])
def relabelled_months(spark, sf_dir):
    """Months with re-coded products' rows under their live code."""
    codes, merges = _merges(spark, sf_dir)
    profit = lambda m: F.when(m.t % 5 != 0, m.qty * 3)
    months = codes.withColumn("months", F.transform("months", lambda m: F.struct(m["item"].alias("item"), m.t.alias("period"), m.qty.alias("qty"), m.turnover_cents.alias("turnover_cents"), profit(m).alias("profit_cents"))))
    return reports.relabelled(months, merges).withColumnRenamed("period", "t")


@register("WITH RECURSIVE " + using("dn", """SELECT c.sku AS old, m.new, arg_min(c.item, (c.t, c.branch, c.item)) AS item, COUNT(DISTINCT c.branch) AS branches, CAST(SUM(c.qty) AS BIGINT) AS units FROM codes c JOIN merges m ON m.branch = c.branch AND m.old = c.sku GROUP BY c.sku, m.new""", **_RECODED)[5:])
def recode_report(spark, sf_dir):
    codes, merges = _merges(spark, sf_dir)
    return reports.merge_report(codes.withColumn("months", F.transform("months", lambda m: F.struct(m["item"].alias("item"), m.t.alias("period"), m.qty.alias("qty")))), merges)


_ALIASES = "SELECT old, arg_min(new, (-n, new)) AS new FROM (SELECT old, new, COUNT(*) AS n FROM merges GROUP BY ALL) GROUP BY old"


@register("WITH RECURSIVE " + using("dn", "SELECT COALESCE(a.new, c.sku) AS sku, CAST(SUM(c.qty) AS BIGINT) AS qty FROM codes c LEFT JOIN aliases a ON a.old = c.sku GROUP BY 1", **_RECODED, aliases=_ALIASES)[5:])
def aliased_sales(spark, sf_dir):
    codes, merges = _merges(spark, sf_dir)
    return reports.aliased(codes.select("sku", recode.total(F.col("months"), "qty").alias("qty")), recode.aliases(merges)).groupBy("sku").agg(F.sum("qty").alias("qty"))


@register("""WITH p AS (SELECT 'P' || p_partkey AS sku, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_partkey ELSE '' END AS item FROM part), q AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'p' || s_suppkey WHEN 1 THEN 'OLD' || s_suppkey WHEN 2 THEN (SELECT MIN(item) FROM p)
      WHEN 3 THEN 'olt ' || s_suppkey ELSE 'bolt' END AS ref FROM supplier), c AS (SELECT q.ref, 1 AS rank, p.sku FROM q JOIN p ON lower(q.ref) = lower(p.sku) UNION ALL SELECT q.ref, 2, 'P' || (s_suppkey + 1) FROM q WHERE s_suppkey % 5 = 1 AND 'P' || (s_suppkey + 1) IN (SELECT sku FROM p)
      UNION ALL SELECT q.ref, 3, p.sku FROM q JOIN p ON lower(q.ref) = lower(p.item) UNION ALL SELECT q.ref, 4, p.sku FROM q JOIN p ON contains(lower(p.item), lower(q.ref)))
    SELECT DISTINCT q.ref, CASE WHEN n = 1 THEN sku END AS sku, CASE WHEN n = 1 THEN rank END AS rank FROM q LEFT JOIN (SELECT ref, rank, COUNT(DISTINCT sku) AS n, MIN(sku) AS sku, ROW_NUMBER() OVER (PARTITION BY ref ORDER BY rank) AS k FROM c GROUP BY ref, rank) b ON b.ref = q.ref AND k = 1""")
def resolved_products(spark, sf_dir):
    """Texts that are codes, old codes, names, parts of names or nothing."""
    key = F.col("p_partkey").cast("string")
    products = tables.table(spark, sf_dir, "part").select(F.concat(F.lit("P"), key).alias("sku"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), key)).otherwise("")).alias("item"))
    first = products.agg(F.min("item").alias("first"))
    supplier = tables.table(spark, sf_dir, "supplier").select("s_suppkey").join(F.broadcast(first))
    n, k = F.col("s_suppkey").cast("string"), F.col("s_suppkey") % 5
    asked = supplier.select(F.when(k == 0, F.concat(F.lit("p"), n)).when(k == 1, F.concat(F.lit("OLD"), n)).when(k == 2, F.col("first")).when(k == 3, F.concat(F.lit("olt "), n)).otherwise("bolt").alias("ref"))
    aliases = supplier.filter(k == 1).select(F.concat(F.lit("OLD"), n).alias("old"), F.concat(F.lit("P"), (F.col("s_suppkey") + 1).cast("string")).alias("new"))
    return reports.resolved(asked, products, aliases)


@register(using("dn", """SELECT product_id, COALESCE(CASE WHEN product_id % 7 = 0 THEN 11 END, CASE WHEN product_id % 5 = 0 THEN product_id * 2 END, SUM(requested_qty))::BIGINT AS qty, CASE WHEN product_id % 7 = 0 THEN 1 WHEN product_id % 5 = 0 THEN 2 ELSE 0 END AS source FROM dn GROUP BY product_id"""))
def quantities_to_split(spark, sf_dir):
    """By hand, else by the receipt, else what is asked for."""
    asked = tables.delivery_lines(spark, sf_dir, product=False).select("product_id", F.col("requested_qty").alias("requested"))
    part = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"))
    return reports.by_precedence(asked, part.filter("product_id % 7 = 0").withColumn("qty", F.lit(11).cast("long")), part.filter("product_id % 5 = 0").withColumn("qty", F.col("product_id") * 2))


@register()
def split_by_branch(spark, sf_dir):
    """The splits of all products as one list for each branch: products and units by kind."""
    return allocation_split(spark, sf_dir).filter("allocated > 0").groupBy("branch_id", "kind").agg(F.count(F.lit(1)).alias("products"), F.sum("allocated").alias("units"))


_WEEK = "CAST(date_trunc('week', doc_date) AS DATE)"


@register(using("items", f"""SELECT * EXCLUDE (place, n_all), CAST(GREATEST(1, CEIL(5 * (place - 1)::DOUBLE / (n_all - 1))) AS INTEGER) AS price_band FROM (
    SELECT g.branch_id, g.product_id, g.week, COALESCE(d.q, 0) AS demand_qty, COALESCE(b.q, 0) AS bo_qty, COALESCE(b.n, 0) AS bo_count, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS price_cents, LEAD(COALESCE(d.q, 0)) OVER o AS target,
      CAST(SUM(COALESCE(b.q, 0)) OVER (o ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS BIGINT) AS bo_qty_roll_4, CAST(week(g.week) AS INTEGER) AS week_of_year, CAST(month(g.week) AS INTEGER) AS month, round_even(sin(week(g.week) * 2 * pi() / 52), 6) + 0 AS sin_woy, round_even(cos(week(g.week) * 2 * pi() / 52), 6) + 0 AS cos_woy,
      CASE WHEN day(g.week) >= 24 THEN 1 ELSE 0 END AS is_month_end_week, ROW_NUMBER() OVER (ORDER BY CAST(ROUND(p_retailprice * 100) AS BIGINT), g.branch_id, g.product_id, g.week) AS place, COUNT(*) OVER () AS n_all
    FROM (SELECT k.branch_id, k.product_id, w.week FROM (SELECT DISTINCT branch_id, product_id FROM recent) k, (SELECT CAST(unnest(generate_series(MIN({_WEEK}), MAX({_WEEK}), INTERVAL 7 DAY)) AS DATE) AS week FROM recent) w) g
    LEFT JOIN (SELECT branch_id, product_id, {_WEEK} AS week, CAST(SUM(requested_qty) AS BIGINT) AS q FROM recent GROUP BY ALL) d ON d.branch_id = g.branch_id AND d.product_id = g.product_id AND d.week = g.week
    LEFT JOIN (SELECT branch_id, product_id, {_WEEK} AS week, CAST(SUM(qty_ordered) AS BIGINT) AS q, COUNT(DISTINCT bo_no) AS n FROM items GROUP BY ALL) b ON b.branch_id = g.branch_id AND b.product_id = g.product_id AND b.week = g.week
    JOIN part ON p_partkey = g.product_id WINDOW o AS (PARTITION BY g.branch_id, g.product_id ORDER BY g.week)) WHERE target IS NOT NULL""", recent="SELECT * FROM lines WHERE age_days BETWEEN 0 AND 546"))
def weekly_training_set(spark, sf_dir):
    """The last 78 weeks."""
    lines = tables.delivery_lines(spark, sf_dir, product=False).filter(F.col("age_days").between(0, 7 * 78))
    prices = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), tables.cents("p_retailprice").alias("price_cents"))
    return reports.weekly_training_set(lines, tables.back_order_items(spark, sf_dir, product=False), prices)


def full_report(spark, sf_dir) -> dict:
    """The back-order report: each of its tables by name."""
    orders, items, events = tables.back_orders(spark, sf_dir), tables.back_order_items(spark, sf_dir), tables.stage_events(spark, sf_dir)
    return {"metrics": flow.metrics(orders, items), "funnel": flow.stage_funnel(orders, ("OPEN", "CLOSED")), "ageing": flow.ageing(orders), "by_branch": flow.by_branch(orders, items), "top_items": flow.top_items(items), "cycle_times": flow.cycle_times(events)}


def _cells_sql(sheet: str, query: str, key: str, figures: str) -> str:
    names = figures.split()
    return f"""SELECT '{sheet}' AS sheet, CAST({key} AS VARCHAR) AS row_key, unnest([{", ".join(f"'{n}'" for n in names)}]) AS metric, unnest([{", ".join(f"{n}::DOUBLE" for n in names)}]) AS value FROM ({oracle_of(query)})"""


_SHEET_KEYS = {"funnel": "stage", "ageing": "bucket", "by_branch": "branch_id", "top_items": "product_id", "cycle_times": "to_stage"}


@register(" UNION ALL ".join([
    _cells_sql("metrics", "flow_metrics", "''", "orders open_orders closed_orders overdue_orders items full_items partial_items nil_items qty_ordered qty_fulfilled outstanding_qty value_outstanding_cents fulfilment_rate mean_lead_days median_lead_days on_time_rate"),
    _cells_sql("funnel", "stage_funnel", "stage", "ord orders outstanding_qty"), _cells_sql("ageing", "open_order_ageing", "bucket", "orders outstanding_qty"),
    _cells_sql("by_branch", "flow_by_branch", "branch_id", "orders open_orders overdue_orders mean_lead_days qty_ordered qty_fulfilled outstanding_qty fulfilment_rate"),
    _cells_sql("top_items", "flow_top_items", "product_id", "orders qty_ordered outstanding_qty value_outstanding_cents"), _cells_sql("cycle_times", "cycle_times", "to_stage", "transitions mean_days median_days p90_days"),
]))
def report_bundle(spark, sf_dir):
    """Every figure of the report's tables."""
    return reports.bundle_cells(full_report(spark, sf_dir), _SHEET_KEYS)


@register(using("heads lines", """SELECT unnest(['orders', 'open_orders', 'overdue_orders', 'outstanding_qty', 'documents', 'lines', 'backorder_qty', 'units_90']) AS metric, unnest([orders, open_orders, overdue_orders, outstanding_qty, documents, n_lines, backorder_qty, units_90]::DOUBLE[]) AS value FROM
    (SELECT COUNT(*) AS orders, COUNT(*) FILTER (status = 'OPEN') AS open_orders, COUNT(*) FILTER (is_overdue) AS overdue_orders, SUM(outstanding_qty) AS outstanding_qty FROM heads WHERE branch = 'NATION_7'),
    (SELECT COUNT(DISTINCT dn_no) AS documents, COUNT(*) AS n_lines, SUM(backorder_qty) AS backorder_qty FROM lines WHERE branch = 'NATION_7'), (SELECT SUM(sent_qty) AS units_90 FROM lines WHERE branch = 'NATION_7' AND doc_date >= DATE '2001-08-31' - 90)"""))
def branch_kpis(spark, sf_dir):
    """The key figures of one branch."""
    return _kpis(spark, sf_dir, "NATION_7")
