"""Panel operators over the whole tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import panel
from ..sources import tables
from .registry import register
from .views import using


def dense_sql(view: str = "panel") -> str:
    return f"""SELECT k.branch, k.sku, CAST(c.t AS INTEGER) AS t, c.period, COALESCE(p.qty, 0) AS qty FROM (SELECT DISTINCT branch, sku FROM {view}) k,
    (SELECT period, ROW_NUMBER() OVER (ORDER BY period) AS t FROM (SELECT CAST(unnest(generate_series(MIN(period), MAX(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM {view})) c
    LEFT JOIN {view} p ON p.branch = k.branch AND p.sku = k.sku AND p.period = c.period"""


def dense(spark, sf_dir, by="region"):
    return panel.densify(tables.monthly_panel(spark, sf_dir, by))


@register(using("panel", "SELECT * FROM dense", dense=dense_sql()))
def dense_panel(spark, sf_dir):
    return dense(spark, sf_dir)


@register(using("fine", """SELECT branch, sku, nnz, round_even(n::DOUBLE / nnz, 4) AS adi, round_even(cv2, 4) AS cv2,
    CASE WHEN nnz = 0 THEN 'dead' WHEN nnz = 1 THEN 'new' WHEN n::DOUBLE / nnz >= 1.32 AND cv2 >= 0.49 THEN 'lumpy' WHEN n::DOUBLE / nnz >= 1.32 THEN 'intermittent'
         WHEN cv2 >= 0.49 THEN 'erratic' ELSE 'smooth' END AS segment FROM (
    SELECT branch, sku, COUNT(*) AS n, COUNT(*) FILTER (qty > 0) AS nnz, (SUM(qty * qty) * COUNT(*) FILTER (qty > 0) - SUM(qty) * SUM(qty))::DOUBLE / (SUM(qty) * SUM(qty)) AS cv2
    FROM dense GROUP BY branch, sku)""", dense=dense_sql("fine")))
def demand_segments(spark, sf_dir):
    return panel.segments(dense(spark, sf_dir, "branch"))


def damped_sql(source: str) -> str:
    """From rows (branch, sku, t, n, qty) to (branch, sku, level)."""
    return f"""SELECT branch, sku, CASE WHEN MAX(qty) > 0 THEN SUM(LEAST(CASE WHEN qty > cap THEN cap + 0.75::DOUBLE * (qty - cap) ELSE qty END, COALESCE(top, 1e300))
        * CASE WHEN t > n - 6 THEN 2 ELSE 1 END)::DOUBLE / SUM(CASE WHEN t > n - 6 THEN 2 ELSE 1 END) ELSE 0 END AS level FROM (
      SELECT *, CASE WHEN COUNT(*) FILTER (qty > 0) OVER s >= 3 THEN GREATEST(cap, 3.0::DOUBLE * CASE WHEN COUNT(*) FILTER (qty > 0 AND t > n - 6) OVER s >= 3
          THEN MEDIAN(qty) FILTER (qty > 0 AND t > n - 6) OVER s ELSE MEDIAN(qty) FILTER (qty > 0) OVER s END) END AS top FROM (
        SELECT *, med + 2 * CASE WHEN mad > 0 THEN mad ELSE GREATEST(med * 0.5::DOUBLE, 1) END AS cap FROM (
          SELECT *, MEDIAN(ABS(qty - med)) OVER s AS mad FROM (SELECT *, MEDIAN(qty) OVER s AS med FROM ({source}) WINDOW s AS (PARTITION BY branch, sku))
          WINDOW s AS (PARTITION BY branch, sku))) WINDOW s AS (PARTITION BY branch, sku)) GROUP BY branch, sku"""


_ALL = "SELECT branch, sku, t, MAX(t) OVER (PARTITION BY branch, sku) AS n, qty FROM dense"
_LAST8 = "SELECT branch, sku, t - n + 8 AS t, 8 AS n, qty FROM (SELECT *, MAX(t) OVER (PARTITION BY branch, sku) AS n FROM dense) WHERE t > n - 8"


@register(using("fine", f"SELECT branch, sku, round_even(level, 6) AS level FROM ({damped_sql(_ALL)})", dense=dense_sql("fine")))
def damped_mean_level(spark, sf_dir):
    series = panel.as_arrays(dense(spark, sf_dir, "branch"))
    return panel.damped_mean(series, "y", "level").select("branch", "sku", F.bround("level", 6).alias("level"))


@register(using("fine", f"""SELECT a.branch, a.sku, round_even(CASE WHEN live THEN level ELSE 0 END, 6) AS level FROM ({damped_sql(_LAST8)}) a
    JOIN (SELECT branch, sku, MAX(qty) FILTER (t > n - 6) > 0 AS live FROM ({_ALL}) GROUP BY branch, sku) b ON a.branch = b.branch AND a.sku = b.sku""", dense=dense_sql("fine")))
def recent_level(spark, sf_dir):
    series = panel.as_arrays(dense(spark, sf_dir, "branch"))
    return panel.recent_level(series, "y", "level").select("branch", "sku", F.bround("level", 6).alias("level"))


def _months(spark, sf_dir) -> list[datetime.date]:
    """The month starts from the first note to the last."""
    ends = tables.table(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("m")).agg(F.min("m").alias("a"), F.max("m").alias("b")).first()
    n = (ends.b.year - ends.a.year) * 12 + ends.b.month - ends.a.month + 1 if ends.a else 0
    return [datetime.date(ends.a.year + (ends.a.month - 1 + i) // 12, (ends.a.month - 1 + i) % 12 + 1, 1) for i in range(n)]


@register(using("dn", """SELECT region AS branch, brand AS sku, period, MIN((dn_no * 13 + line_no) % 50) AS reading FROM dn JOIN (
      SELECT doc_date, period FROM (SELECT doc_date, p.period, ROW_NUMBER() OVER (PARTITION BY doc_date ORDER BY ABS(doc_date - p.period), p.period) AS k
        FROM (SELECT DISTINCT doc_date FROM dn), (SELECT CAST(unnest(generate_series((SELECT date_trunc('month', MIN(doc_date)) FROM dn), (SELECT date_trunc('month', MAX(doc_date)) FROM dn), INTERVAL 1 MONTH)) AS DATE) AS period) p
        WHERE ABS(doc_date - p.period) <= 15) WHERE k = 1) near ON dn.doc_date = near.doc_date GROUP BY region, brand, period"""))
def stock_by_nearest_period(spark, sf_dir):
    """Readings put to the nearest month start within 15 days, the least of each."""
    readings = tables.delivery_lines(spark, sf_dir).select("region", "brand", "doc_date", ((F.col("dn_no") * 13 + F.col("line_no")) % 50).alias("reading"))
    near = panel.nearest_period(readings, "doc_date", _months(spark, sf_dir), 15).filter("period is not null")
    return near.groupBy(F.col("region").alias("branch"), F.col("brand").alias("sku"), "period").agg(F.min("reading").alias("reading"))


@register(using("panel", """SELECT branch, sku, week_start, qty FROM (SELECT branch, sku, week_start, round_even(SUM(qty * days::DOUBLE / span), 2) AS qty FROM (
      SELECT branch, sku, qty, CAST(date_trunc('week', d) AS DATE) AS week_start, COUNT(*) AS days, MAX(day(last_day(period))) AS span FROM
      (SELECT *, CAST(unnest(generate_series(period, last_day(period), INTERVAL 1 DAY)) AS DATE) AS d FROM panel) GROUP BY branch, sku, period, qty, CAST(date_trunc('week', d) AS DATE))
    WHERE (week_start - DATE '1995-01-02') // 7 % 10 <> 0 GROUP BY branch, sku, week_start) WHERE qty > 0"""))
def months_to_weeks(spark, sf_dir):
    """Monthly units as weeks; every tenth week is taken as covered by real readings."""
    last = _months(spark, sf_dir)[-1:]
    covered = spark.sql(f"select explode(sequence(date'1995-01-02', add_months(date'{last[0]}', 1), interval 70 days)) as week_start") if last else None
    return panel.months_to_weeks(tables.monthly_panel(spark, sf_dir), "qty", covered)


_RANGES = """SELECT region AS branch, CAST(date_trunc('month', doc_date) AS DATE) AS period, MIN(day(doc_date)) FILTER (line_no > 5) AS old_from, MAX(day(doc_date)) FILTER (line_no > 5) AS old_to,
    MIN(day(doc_date)) FILTER (line_no <= 2 AND day(doc_date) > 9) AS new_from, MAX(day(doc_date)) FILTER (line_no <= 2 AND day(doc_date) > 9) AS new_to FROM dn GROUP BY 1, 2"""


@register(using("dn", """SELECT branch, period, CAST(old_from AS INTEGER) AS old_from, CAST(old_to AS INTEGER) AS old_to, CAST(new_from AS INTEGER) AS new_from, CAST(new_to AS INTEGER) AS new_to,
    CASE WHEN old_from IS NULL THEN 'save' WHEN new_from <= old_from AND new_to >= old_to THEN 'replace' WHEN new_from >= old_from AND new_to <= old_to THEN 'skip'
         WHEN new_from = old_to + 1 OR new_to = old_from - 1 THEN 'add' ELSE 'reject' END AS decision FROM ranges WHERE new_from IS NOT NULL""", ranges=_RANGES))
def part_month_decisions(spark, sf_dir):
    """Two part-month loads of each region and month, told apart by line number, and how they would be merged."""
    day, late = F.dayofmonth("doc_date"), (F.col("line_no") <= 2) & (F.dayofmonth("doc_date") > 9)
    old, new = F.when(F.col("line_no") > 5, day), F.when(late, day)
    ranges = tables.delivery_lines(spark, sf_dir).groupBy(F.col("region").alias("branch"), F.trunc("doc_date", "month").alias("period")).agg(F.min(old).alias("old_from"), F.max(old).alias("old_to"), F.min(new).alias("new_from"), F.max(new).alias("new_to"))
    decision = panel.merge_decision(*(F.col(c) for c in ("old_from", "old_to", "new_from", "new_to")))
    return ranges.filter("new_from is not null").withColumn("decision", decision)


@register()
def uncensored_demand(spark, sf_dir):
    """Nation by brand series, made scarce in some months, with readings of none on hand for half of these and of some
    for other months: probable stockouts lifted to the in-stock level."""
    series = panel.as_arrays(dense(spark, sf_dir, "branch"))
    scarce = lambda i: (i + F.length("branch")) % 9 == 4
    sold = F.transform("y", lambda v, i: F.when(scarce(i), F.lit(0.0)).otherwise(v))
    held = F.transform("y", lambda v, i: F.when(scarce(i) & (i % 2 == 0), 0.0).when(i % 5 == 0, 40.0))
    found = panel.uncensor(series.select("branch", "sku", sold.alias("y"), held.alias("on_hand")))
    return found.select("branch", "sku", F.bround("level", 6).alias("level"), F.size(F.filter("masked", lambda m: m)).alias("masked"), F.bround(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 4).alias("units"))


_PAST = "OVER (PARTITION BY branch, sku ORDER BY t ROWS BETWEEN {} PRECEDING AND {} PRECEDING)"
_LAGS = ", ".join(f"LAG(qty, {k}) OVER o AS lag_{k}" for k in (1, 2, 3, 4, 8))
_MEANS = ", ".join(f"round_even(AVG(qty) {_PAST.format(k, 1)}, 6) AS mean_{k}, round_even(STDDEV_SAMP(qty) {_PAST.format(k, 1)}, 6) AS std_{k}" for k in (4, 8, 13))


@register(using("panel", f"""SELECT * EXCLUDE (island), CAST(CASE WHEN island > 0 THEN ROW_NUMBER() OVER (PARTITION BY branch, sku, island ORDER BY t) - 1
      ELSE ROW_NUMBER() OVER (PARTITION BY branch, sku, island ORDER BY t) END AS INTEGER) AS periods_since_sale FROM (
    SELECT branch, sku, t, period, qty, {_LAGS}, {_MEANS}, round_even(AVG(qty) {_PAST.format(8, 5)}, 6) AS trend_mean,
    CASE WHEN COUNT(*) {_PAST.format(13, 1)} >= 4 THEN round_even(SUM(CASE WHEN qty = 0 THEN 1 ELSE 0 END) {_PAST.format(13, 1)}::DOUBLE / LEAST(t, 13), 6) END AS zero_share_13,
    SUM(CASE WHEN qty > 0 THEN 1 ELSE 0 END) OVER o AS island, LEAD(qty) OVER o AS target FROM dense WINDOW o AS (PARTITION BY branch, sku ORDER BY t)) WHERE target IS NOT NULL""", dense=dense_sql()))
def training_set(spark, sf_dir):
    return panel.lag_features(dense(spark, sf_dir))
