"""Stock splits, re-coded products and family demand over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allocation, planning, recode
from ..sources import tables
from ..streaming import jobs
from .planning_queries import _RATES, _rates
from .registry import register
from .views import using

_SUPPLY = "product_id * 37 % 200"


def _supply(spark, sf_dir):
    """Units of each product in the warehouse, a fixed function of its key."""
    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_partkey") * 37 % 200).alias("available"))


@register(using("lines", f"""SELECT product_id, branch_id, available, CAST(filled AS BIGINT) AS filled,
    CAST(filled + CASE WHEN rest > 0 THEN FLOOR(round_even(rest * rate / network, 9)) ELSE 0 END AS BIGINT) AS allocated, round_even(round_even(rate * 100 / network, 8), 1) AS share_pct,
    round_even(round_even((filled + CASE WHEN rest > 0 THEN FLOOR(round_even(rest * rate / network, 9)) ELSE 0 END) * 7 / rate, 8), 1) AS days_covered
    FROM (SELECT *, available - SUM(filled) OVER (PARTITION BY product_id) AS rest FROM (SELECT *, GREATEST(0, LEAST(wants, available - COALESCE(ahead, 0))) AS filled FROM (
      SELECT *, SUM(wants) OVER (PARTITION BY product_id ORDER BY rate DESC, branch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead, SUM(rate) OVER (PARTITION BY product_id) AS network
      FROM (SELECT product_id, branch_id, rate, {_SUPPLY} AS available, CAST(CEIL(rate * 1.2::DOUBLE + rate * 2) AS BIGINT) AS wants FROM rates WHERE rate > 0))))""", rates=_RATES))
def allocation_fair_share(spark, sf_dir):
    need = _rates(spark, sf_dir).filter("rate > 0").select("product_id", "branch_id", "rate", (F.col("rate") * planning.SAFETY_WEEKS + F.col("rate") * planning.LEAD_WEEKS).alias("reorder_point"))
    return allocation.fair_share(need, _supply(spark, sf_dir))


@register(using("lines stock", """SELECT product_id, branch_id, on_hand, reorder_point, suggested, CAST(SUM(suggested) OVER (PARTITION BY product_id) AS BIGINT) AS total_need FROM (
    SELECT *, GREATEST(0, reorder_point - on_hand) AS suggested FROM (SELECT r.product_id, r.branch_id, COALESCE(on_hand, 0) AS on_hand,
      CAST(round_even(rate * 1.2::DOUBLE + rate * 2, 0) AS BIGINT) AS reorder_point FROM rates r LEFT JOIN stock s ON r.branch_id = s.branch_id AND r.product_id = s.product_id WHERE rate > 0))""", rates=_RATES))
def allocation_demand_plan(spark, sf_dir):
    return allocation.demand_plan(planning.reorder_points(_rates(spark, sf_dir), tables.stock_levels(spark, sf_dir)))


@register()
def allocation_split(spark, sf_dir):
    """Every product's warehouse stock over all branches: cover, probes, held."""
    rates = _rates(spark, sf_dir)
    sizes = rates.groupBy("branch_id").agg(F.sum("rate").alias("branch_size"))
    universe = rates.select("product_id").distinct().join(F.broadcast(sizes))  # 25 branches at most
    rows = universe.join(rates.select("product_id", "branch_id", F.greatest("rate", F.col("recent_sales") / 4).alias("rate"), "weeks_sold"), ["product_id", "branch_id"], "left")
    rows = rows.join(tables.stock_levels(spark, sf_dir).select("product_id", "branch_id", "on_hand"), ["product_id", "branch_id"], "left").join(_supply(spark, sf_dir).withColumnRenamed("available", "qty"), "product_id")
    return allocation.split_product(rows.na.fill(0, ["rate", "weeks_sold", "on_hand"]))


@register()
def allocation_by_request(spark, sf_dir):
    """What branches requested in the last quarter, out of the warehouse's stock."""
    lines = tables.delivery_lines(spark, sf_dir, product=False).filter(F.col("age_days").between(0, 91))
    asked = lines.groupBy("product_id", "branch_id").agg(F.sum("requested_qty").alias("requested"))
    rows = asked.join(_rates(spark, sf_dir).select("product_id", "branch_id", "rate"), ["product_id", "branch_id"], "left").join(tables.stock_levels(spark, sf_dir).select("product_id", "branch_id", "on_hand"), ["product_id", "branch_id"], "left")
    return allocation.split_requests(rows.na.fill(0, ["rate", "on_hand"]).join(_supply(spark, sf_dir).withColumnRenamed("available", "qty"), "product_id"))


@register()
def weekly_order(spark, sf_dir):
    plan = planning.transport_plan(_rates(spark, sf_dir), tables.stock_levels(spark, sf_dir))
    return allocation.weekly_order(plan.select("product_id", "branch_id", "demand", "to_transport"), _supply(spark, sf_dir))


@register(using("dn", """SELECT branch_id, product_id, seq, change, CAST(run - LEAST(0, MIN(run) OVER (PARTITION BY branch_id, product_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS balance FROM (
    SELECT *, SUM(change) OVER (PARTITION BY branch_id, product_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT branch_id, product_id, dn_no * 10 + line_no AS seq, CAST(SUM(requested_qty - 2 * sent_qty) AS BIGINT) AS change FROM dn GROUP BY ALL))"""))
def stock_ledger(spark, sf_dir):
    lines = tables.delivery_lines(spark, sf_dir, product=False)
    moves = lines.groupBy("branch_id", "product_id", (F.col("dn_no") * 10 + F.col("line_no")).alias("seq")).agg(F.sum(F.col("requested_qty") - 2 * F.col("sent_qty")).alias("change"))
    return allocation.ledger(moves)


_CODES = """SELECT region AS branch, product_id AS sku, brand || ' ' || category AS item, year(doc_date) * 12 + month(doc_date) AS t, SUM(requested_qty) AS qty, SUM(revenue_cents) AS turnover
    FROM dn GROUP BY ALL"""
_LIFE = """SELECT branch, sku, regexp_replace(upper(any_value(item)), '[^A-Z0-9]+', '', 'g') AS name, MIN(t) AS first, MAX(t) AS last, COUNT(*) AS n, SUM(turnover)::DOUBLE / SUM(qty) AS price
    FROM codes WHERE qty > 0 GROUP BY branch, sku"""
_BEST = """SELECT branch, old, old_n, arg_min(new, k) AS new FROM (SELECT a.branch, a.name, a.sku AS old, a.n AS old_n, c.sku AS new, row_number() OVER (PARTITION BY a.branch, a.sku ORDER BY c.first, c.n DESC, c.sku) AS k
    FROM life a JOIN life c ON a.branch = c.branch AND a.name = c.name AND a.sku <> c.sku AND a.last <= c.first AND c.last > a.last
    WHERE length(a.name) >= 5 AND c.price / a.price BETWEEN 1 / 1.67::DOUBLE AND 1.67::DOUBLE) GROUP BY branch, old, old_n"""
_FOUND = """SELECT branch, old, new, 'branch' AS basis FROM best WHERE old_n >= 4 UNION ALL SELECT branch, old, new, 'company-wide' FROM best WHERE old_n < 4 AND (old, new) IN (
    SELECT (old, new) FROM best WHERE old_n >= 4 GROUP BY old, new HAVING COUNT(DISTINCT branch) >= 3)"""


def _codes(spark, sf_dir):
    """recode.histories() of regions and products, stored: lines move to their product once, for all that is asked of them."""
    lines = tables.delivery_lines(spark, sf_dir, product=False)
    sold = lines.select(F.col("region").alias("branch"), F.col("product_id").alias("sku"), (F.year("doc_date") * 12 + F.month("doc_date")).alias("t"), "requested_qty", "revenue_cents")
    n = max(tables.tasks(tables.table(spark, sf_dir, "lineitem")), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = sold.repartition(n, "sku").groupBy("branch", "sku", "t").agg(F.sum("requested_qty").alias("qty"), F.sum("revenue_cents").alias("turnover_cents"))
    series = sums.groupBy("branch", "sku").agg(F.collect_list(F.struct("t", "qty", "turnover_cents")).alias("months"))
    part = tables.table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("sku"), F.concat_ws(" ", "p_brand", "p_type").alias("item")).agg(F.count(F.lit(1)).alias("times"))
    items = part.groupBy("sku").agg(F.collect_list(F.struct("item", "times")).alias("items"))  # one, but for keys that repeat
    months = F.flatten(F.transform("items", lambda i: F.transform("months", lambda m: F.struct(i["item"].alias("item"), m.t.alias("t"), (m.qty * i.times).alias("qty"), (m.turnover_cents * i.times).alias("turnover_cents")))))
    return jobs.kept(series.join(recode.sorted_join(items), "sku").select("branch", "sku", months.alias("months")), "codes")


@register(using("dn", "SELECT * FROM found", codes=_CODES, life=_LIFE, best=_BEST, found=_FOUND))
def recoded_skus(spark, sf_dir):
    return recode.find_recodes(_codes(spark, sf_dir))


_WALK = "SELECT branch, old, new, basis, 1 AS depth FROM found UNION ALL SELECT w.branch, w.old, f.new, w.basis, depth + 1 FROM walk w JOIN found f ON w.branch = f.branch AND w.new = f.old"


@register("WITH RECURSIVE " + using("dn", """SELECT branch, old, arg_max(new, depth) AS new, any_value(basis) AS basis FROM walk GROUP BY branch, old""", codes=_CODES, life=_LIFE, best=_BEST, found=_FOUND, walk="""
    SELECT branch, old, new, basis, 1 AS depth FROM found UNION ALL SELECT w.branch, w.old, f.new, w.basis, depth + 1 FROM walk w JOIN found f ON w.branch = f.branch AND w.new = f.old""")[5:])
def recode_chains(spark, sf_dir):
    return recode.follow(recode.find_recodes(_codes(spark, sf_dir)))


@register("WITH RECURSIVE " + using("dn", """SELECT c.branch, COALESCE(m.new, c.sku) AS sku, c.t, round_even(SUM(c.qty * CASE WHEN m.new IS NULL THEN 1 ELSE LEAST(1, GREATEST(0.25::DOUBLE, since / before)) END), 4) AS qty FROM codes c LEFT JOIN merges m ON m.branch = c.branch AND m.old = c.sku
    LEFT JOIN (SELECT branch, sku, AVG(qty)::DOUBLE AS before FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY branch, sku ORDER BY t DESC) AS back FROM codes WHERE qty > 0) WHERE back <= 6 GROUP BY ALL) b ON b.branch = c.branch AND b.sku = m.old
    LEFT JOIN (SELECT branch, sku, SUM(qty)::DOUBLE / ((SELECT MAX(t) FROM codes) - MIN(t) + 1) AS since FROM codes WHERE qty > 0 GROUP BY ALL) s ON s.branch = c.branch AND s.sku = m.new GROUP BY 1, 2, 3""",
    codes=_CODES, life=_LIFE, best=_BEST, found=_FOUND, walk=_WALK, merges="SELECT branch, old, arg_max(new, depth) AS new FROM walk GROUP BY branch, old")[5:])
def merged_history(spark, sf_dir):
    """The monthly history with re-coded products' rows under their last code."""
    codes = _codes(spark, sf_dir)
    merged = recode.merge_history(codes, recode.shares(codes, recode.follow(recode.find_recodes(codes))))
    return merged.select("branch", "sku", "t", F.bround("qty", 4).alias("qty"))


@register("WITH RECURSIVE " + using("dn", """SELECT old, arg_min(new, (-n, new)) AS new FROM (SELECT old, new, COUNT(*) AS n FROM (SELECT branch, old, arg_max(new, depth) AS new FROM walk GROUP BY branch, old) GROUP BY ALL) GROUP BY old""",
    codes=_CODES, life=_LIFE, best=_BEST, found=_FOUND, walk=_WALK)[5:])
def recode_aliases(spark, sf_dir):
    return recode.aliases(recode.follow(recode.find_recodes(_codes(spark, sf_dir))))


@register()
def family_borrowing(spark, sf_dir):
    """Rates of nations' products drawn towards those of the same name."""
    lines = tables.delivery_lines(spark, sf_dir, product=False)
    monthly = lines.groupBy("branch", F.col("product_id").alias("sku"), F.trunc("doc_date", "month").alias("period")).agg(F.sum("requested_qty").alias("qty"))
    names = tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("item"))
    return recode.lend(recode.monthly_facts(monthly, names))


@register()
def matched_descriptions(spark, sf_dir):
    """Part names with a letter missing, matched to the catalogue."""
    names = tables.table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("sku"))
    asked = names.select(F.expr("substring(name, 1, length(name) - 1)").alias("description"))
    return recode.match_descriptions(asked, names)
