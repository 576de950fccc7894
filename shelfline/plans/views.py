"""The adapters of sources/tables.py as SQL, for checking the registered queries."""

from __future__ import annotations

VIEWS = {
    "dn": """SELECT l.l_orderkey AS dn_no, l.l_linenumber AS line_no, CAST(o.o_orderdate AS DATE) AS doc_date, c.c_nationkey AS branch_id,
        n.n_name AS branch, r.r_name AS region, l.l_partkey AS product_id, p.p_name AS description, p.p_type AS category,
        p.p_brand AS brand, CAST(l.l_quantity AS BIGINT) AS requested_qty,
        CASE l.l_returnflag WHEN 'N' THEN CAST(l.l_quantity AS BIGINT) WHEN 'A' THEN CAST(FLOOR(l.l_quantity / 2) AS BIGINT)
             ELSE CAST(0 AS BIGINT) END AS sent_qty,
        l.l_linestatus AS line_status, o.o_orderstatus AS order_status,
        CAST(ROUND(p.p_retailprice * 100) AS BIGINT) AS price_cents, CAST(ROUND(l.l_extendedprice * 100) AS BIGINT) AS revenue_cents
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
        JOIN part p ON l.l_partkey = p.p_partkey""",
    "lines": """SELECT *, GREATEST(requested_qty - sent_qty, 0) AS backorder_qty,
        CASE WHEN requested_qty <= sent_qty THEN 'FULL' WHEN sent_qty = 0 THEN 'NIL' ELSE 'PARTIAL' END AS fill_status,
        GREATEST(requested_qty - sent_qty, 0) * price_cents AS backorder_cents,
        CAST(DATE '2001-08-31' - doc_date AS INTEGER) AS age_days FROM dn""",
    "items": """SELECT *, GREATEST(qty_ordered - qty_fulfilled, 0) AS outstanding_qty,
        CASE WHEN qty_ordered <= qty_fulfilled THEN 'FULL' WHEN qty_fulfilled = 0 THEN 'NIL' ELSE 'PARTIAL' END AS fill_status,
        GREATEST(qty_ordered - qty_fulfilled, 0) * price_cents AS value_outstanding_cents
        FROM (SELECT dn_no AS bo_no, line_no, branch_id, branch, product_id, description, category, price_cents, doc_date,
              CASE WHEN order_status = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS status, backorder_qty AS qty_ordered,
              CASE WHEN line_status = 'F' THEN backorder_qty ELSE backorder_qty // 2 END AS qty_fulfilled
              FROM lines WHERE backorder_qty > 0)""",
    "heads": """SELECT *, CAST(closed_at - submitted_at AS INTEGER) AS lead_time_days, status = 'OPEN' AND age_days > 14 AS is_overdue FROM (
        SELECT bo_no, branch_id, branch, status, status AS stage, doc_date AS submitted_at, COUNT(*) AS items,
        CAST(SUM(qty_ordered) AS BIGINT) AS qty_ordered, CAST(SUM(qty_fulfilled) AS BIGINT) AS qty_fulfilled,
        CAST(SUM(qty_ordered) - SUM(qty_fulfilled) AS BIGINT) AS outstanding_qty,
        CAST(SUM(value_outstanding_cents) AS BIGINT) AS value_outstanding_cents,
        CASE WHEN status = 'CLOSED' THEN CAST(doc_date + CAST(bo_no % 45 + 1 AS INTEGER) AS DATE) END AS closed_at,
        CAST(DATE '2001-08-31' - doc_date AS INTEGER) AS age_days, 14 AS sla_days
        FROM items GROUP BY bo_no, branch_id, branch, status, doc_date)""",
    "stages": "SELECT user_id AS bo_no, event_id, event_type AS to_stage, epoch_us(ts) AS at_us FROM events",
    "panel": """SELECT region AS branch, brand AS sku, CAST(date_trunc('month', doc_date) AS DATE) AS period,
        CAST(SUM(requested_qty) AS BIGINT) AS qty, CAST(SUM(revenue_cents) AS BIGINT) AS turnover_cents
        FROM dn GROUP BY region, brand, CAST(date_trunc('month', doc_date) AS DATE)""",
    "fine": """SELECT branch, brand AS sku, CAST(date_trunc('month', doc_date) AS DATE) AS period,
        CAST(SUM(requested_qty) AS BIGINT) AS qty, CAST(SUM(revenue_cents) AS BIGINT) AS turnover_cents
        FROM dn GROUP BY branch, brand, CAST(date_trunc('month', doc_date) AS DATE)""",
    "stock": "SELECT DISTINCT branch_id, branch, product_id, (branch_id * 31 + product_id * 17) % 120 AS on_hand FROM dn",
}
_NEEDS = {"dn": (), "lines": ("dn",), "items": ("lines",), "heads": ("items",), "stages": (), "panel": ("dn",), "fine": ("dn",), "stock": ("dn",)}


def using(views: str, body: str, **ctes: str) -> str:
    """SQL with the named views (and what they need) and further CTEs in front of body."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS[name]:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for v in views.split():
        need(v)
    parts = [f"{v} AS ({VIEWS[v]})" for v in wanted] + [f"{k} AS ({v})" for k, v in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
