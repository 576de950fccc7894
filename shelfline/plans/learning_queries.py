"""Learned forecasts, their validation and the served forecast over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, files, forecast, learning, panel, saved_models, serving
from ..sources import tables
from ..streaming import jobs, loads
from .panel_queries import _months, dense, dense_sql
from .registry import register
from .views import using

HORIZON, ORIGINS = 3, 4


def _series(spark, sf_dir):
    """Series of the regions' brands. Months and series are stored, so that fits, which read them many times, don't read the
    lines again."""
    months = jobs.kept(tables.monthly_panel(spark, sf_dir), "months")
    return jobs.kept(panel.as_arrays(panel.densify(months)).join(tables.brands(spark, sf_dir).select("sku", "category"), "sku"), "series")


def _first_month(spark, sf_dir) -> int:
    return next((m.month for m in _months(spark, sf_dir)), 1)


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(item, '{words}', 'i') THEN '{label}'" for label, words in files.CATEGORIES) + f" ELSE '{files.OTHER_CATEGORY}' END"
_BRANDS = f"SELECT sku, {_CATEGORY} AS category FROM (SELECT p_brand AS sku, MIN(p_name) AS item FROM part GROUP BY 1)"
_LAGGED = ", ".join(f"COALESCE(LAG(qty, {k}) OVER o, 0)::DOUBLE AS lag{k}" for k in range(1, 7))


@register(using("panel", f"""SELECT branch, sku, {", ".join(f"lag{k}" for k in range(1, 7))}, round_even(roll4_mean, 6) AS roll4_mean, roll4_max, round_even(roll8_mean, 6) AS roll8_mean, round_even(roll8_std, 6) AS roll8_std,
    round_even(mean_all, 6) AS mean_all, round_even(std_all, 6) AS std_all, max_all, round_even(nnz / n, 6) AS nz_rate, CASE WHEN nnz > 0 THEN n - last ELSE n END AS since_sale, round_even(CASE WHEN nnz > 0 THEN n / nnz ELSE n END, 6) AS adi,
    round_even(CASE WHEN nnz > 0 THEN vs / (ms * ms + 1e-9::DOUBLE) ELSE 0 END, 6) AS cv2, round_even(roll4_mean - CASE WHEN n >= 8 THEN before4 ELSE 0 END, 6) AS trend, n AS t_idx, month, branch_id, cat_id, target, weight FROM (
    SELECT d.branch, d.sku, {_LAGGED}, AVG(qty) OVER p4 AS roll4_mean, CAST(MAX(qty) OVER p4 AS DOUBLE) AS roll4_max, AVG(qty) OVER p8 AS roll8_mean, STDDEV_POP(qty) OVER p8 AS roll8_std, AVG(qty) OVER p AS mean_all, STDDEV_POP(qty) OVER p AS std_all,
      CAST(MAX(qty) OVER p AS DOUBLE) AS max_all, CAST(COUNT(*) FILTER (qty > 0) OVER p AS DOUBLE) AS nnz, CAST(t - 1 AS DOUBLE) AS n, CAST(MAX(t) FILTER (qty > 0) OVER p AS DOUBLE) AS last, VAR_POP(qty) FILTER (qty > 0) OVER p AS vs, AVG(qty) FILTER (qty > 0) OVER p AS ms,
      AVG(qty) OVER b4 AS before4, CAST(month(period) AS DOUBLE) AS month, b.id::DOUBLE AS branch_id, c.id::DOUBLE AS cat_id, CAST(qty AS DOUBLE) AS target, CASE WHEN MAX(t) OVER (PARTITION BY d.branch, d.sku) - t < 6 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, t
    FROM dense d JOIN (SELECT branch, ROW_NUMBER() OVER (ORDER BY branch) - 1 AS id FROM (SELECT DISTINCT branch FROM dense)) b ON d.branch = b.branch JOIN brands g ON g.sku = d.sku
      JOIN (SELECT category, ROW_NUMBER() OVER (ORDER BY category) - 1 AS id FROM (SELECT DISTINCT category FROM brands WHERE sku IN (SELECT sku FROM dense))) c ON c.category = g.category
    WINDOW o AS (PARTITION BY d.branch, d.sku ORDER BY t), p AS (PARTITION BY d.branch, d.sku ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p4 AS (PARTITION BY d.branch, d.sku ORDER BY t ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
      p8 AS (PARTITION BY d.branch, d.sku ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), b4 AS (PARTITION BY d.branch, d.sku ORDER BY t ROWS BETWEEN 8 PRECEDING AND 5 PRECEDING)) WHERE t > 4""", dense=dense_sql(), brands=_BRANDS))
def series_features(spark, sf_dir):
    """Training rows; the levels by Croston and the damped mean have queries of their own."""
    rows = learning.design(_series(spark, sf_dir), _first_month(spark, sf_dir)).drop("croston", "damped")
    rounded = ["roll4_mean", "roll8_mean", "roll8_std", "mean_all", "std_all", "nz_rate", "adi", "cv2", "trend"]
    return rows.withColumns({c: F.bround(c, 6) for c in rounded})


def _learned(spark, sf_dir, fit, ratio=False):
    """The next months of each region and brand, told step by step."""
    series, month = _series(spark, sf_dir), _first_month(spark, sf_dir)
    model = fit(learning.design(series, month).persist())
    told = learning.recursive(model, series, month, HORIZON, ratio)
    return told.select("branch", "sku", F.posexplode(F.transform("yhat", lambda v: F.bround(v, 4))).alias("h", "yhat"))


@register()
def trees_forecast(spark, sf_dir):
    return _learned(spark, sf_dir, learning.fit_trees)


@register()
def tweedie_forecast(spark, sf_dir):
    return _learned(spark, sf_dir, learning.fit_tweedie)


@register()
def ratio_forecast(spark, sf_dir):
    return _learned(spark, sf_dir, learning.fit_ratio, True)


def _origins(spark, sf_dir):
    return learning.rolling_origins(_series(spark, sf_dir).select("branch", "sku", "y"), ORIGINS)


_CUT = """SELECT o.k AS origin, d.branch, d.sku, d.qty, d.t, m.n - o.k + 1 AS pos FROM dense d JOIN (SELECT branch, sku, MAX(t) AS n FROM dense GROUP BY ALL) m ON d.branch = m.branch AND d.sku = m.sku, (SELECT unnest([1, 2, 3, 4]) AS k) o WHERE d.t <= m.n - o.k + 1"""


@register(using("panel", """SELECT origin, branch, sku, last_month, snaive, actual FROM (SELECT CAST(origin AS INTEGER) AS origin, branch, sku, CEIL(round_even(MAX(qty) FILTER (t = pos - 1) * 1.1::DOUBLE, 6)) AS last_month,
    CAST(MAX(qty) FILTER (t = pos - 4) AS DOUBLE) AS snaive, CAST(MAX(qty) FILTER (t = pos) AS DOUBLE) AS actual FROM cut GROUP BY ALL)""", dense=dense_sql(), cut=_CUT))
def rolling_origin_forecasts(spark, sf_dir):
    """Two of the models at each origin; the tests hold the others."""
    told = _origins(spark, sf_dir).groupBy("origin", "branch", "sku", "actual").pivot("model", ["last_month", "snaive"]).agg(F.first("yhat"))
    return told.select("origin", "branch", "sku", "last_month", "snaive", "actual")


@register()
def fitted_blend(spark, sf_dir):
    """Weights of the models that fit the last origins best."""
    return spark.createDataFrame(list(learning.fit_blend(_origins(spark, sf_dir), list(forecast.MODELS)).items()), "model string, weight double")


def _held_out(spark, sf_dir):
    """Cells of the last months with a reading of none on hand for some of them."""
    series = _series(spark, sf_dir).select("branch", "sku", "y")
    split = forecast.hold_out(series, HORIZON)
    levels = forecast.model_levels(split, HORIZON).join(split.select("branch", "sku", "actual"), ["branch", "sku"]).join(panel.segments(dense(spark, sf_dir)).select("branch", "sku", "segment"), ["branch", "sku"])
    cells = levels.select("model", "segment", "sku", F.posexplode(F.arrays_zip("actual", "yhat")).alias("h", "c"))
    return split, cells.select("model", "segment", ((F.length("sku") + F.col("h")) % 4 != 0).alias("in_stock"), F.col("c.actual").alias("a"), F.col("c.yhat").alias("f"))


@register(using("panel", """SELECT 'last_month' AS model, segment, round_even(AVG(ABS(f - a)), 3) AS mae, round_even(sqrt(AVG((f - a) * (f - a))), 3) AS rmse, round_even(100 * SUM(ABS(f - a)) / SUM(a), 1) AS wape,
    round_even(100 * SUM(f - a) / SUM(a), 1) AS bias, round_even(AVG(ABS(f - a)) / ANY_VALUE(scale), 3) AS mase FROM (
    SELECT unnest([s.segment, 'all']) AS segment, f.f, d.qty AS a, scale FROM dense d JOIN (SELECT branch, sku, MAX(t) AS n FROM dense GROUP BY ALL) m ON d.branch = m.branch AND d.sku = m.sku
      JOIN (SELECT d.branch, d.sku, CEIL(round_even(qty * 1.1::DOUBLE, 6)) AS f FROM dense d JOIN (SELECT branch, sku, MAX(t) AS n FROM dense GROUP BY ALL) m ON d.branch = m.branch AND d.sku = m.sku AND d.t = m.n - 3) f ON f.branch = d.branch AND f.sku = d.sku
      JOIN (SELECT branch, sku, CASE WHEN nnz = 0 THEN 'dead' WHEN nnz = 1 THEN 'new' WHEN n::DOUBLE / nnz >= 1.32 AND cv2 >= 0.49 THEN 'lumpy' WHEN n::DOUBLE / nnz >= 1.32 THEN 'intermittent' WHEN cv2 >= 0.49 THEN 'erratic' ELSE 'smooth' END AS segment FROM (
        SELECT branch, sku, COUNT(*) AS n, COUNT(*) FILTER (qty > 0) AS nnz, (SUM(qty * qty) * COUNT(*) FILTER (qty > 0) - SUM(qty) * SUM(qty))::DOUBLE / (SUM(qty) * SUM(qty)) AS cv2 FROM dense GROUP BY branch, sku)) s ON s.branch = d.branch AND s.sku = d.sku,
      (SELECT AVG(ABS(qty - before)) AS scale FROM (SELECT qty, LAG(qty) OVER (PARTITION BY d.branch, d.sku ORDER BY t) AS before FROM dense d JOIN (SELECT branch, sku, MAX(t) AS n FROM dense GROUP BY ALL) m ON d.branch = m.branch AND d.sku = m.sku WHERE t <= n - 3) WHERE before IS NOT NULL)
    WHERE d.t > m.n - 3 AND (length(d.sku) + d.t - m.n + 2) % 4 <> 0) GROUP BY segment""", dense=dense_sql()))
def in_stock_scores(spark, sf_dir):
    """The last-month rule's errors over cells in stock, by segment."""
    split, cells = _held_out(spark, sf_dir)
    moves = F.transform(F.sequence(F.lit(1), F.size("y") - 1), lambda i: F.abs(F.get(F.col("y"), i) - F.get(F.col("y"), i - 1)))
    scale = split.agg((F.sum(forecast._sum(moves)) / F.sum(F.size("y") - 1)).alias("s")).first().s
    return learning.in_stock_scores(cells, scale or 1.0).filter("model = 'last_month'")


@register()
def model_choice(spark, sf_dir):
    """The model to serve, by its held-out errors and the active series it tells nothing for."""
    split, cells = _held_out(spark, sf_dir)
    table = learning.in_stock_scores(cells, 1.0).filter("segment = 'all'")
    return learning.chosen(table, learning.dead_share(forecast.model_levels(split, HORIZON), split))


@register()
def forecast_state(spark, sf_dir):
    return learning.forecast_state(_series(spark, sf_dir).select("branch", "sku", "y"), tables.brands(spark, sf_dir).select("sku", "category"))


@register()
def boosted_forecast(spark, sf_dir):
    """The next months by trees boosted on the Tweedie deviance, saved, loaded again and told step by step."""
    folder = jobs.work_folder(spark, "saved-models")
    series, month = _series(spark, sf_dir), _first_month(spark, sf_dir)
    rows = learning.design(series, month)
    signed = loads.signature(series.select("branch", "sku", "y"), []).first()
    saved_models.trained(spark, folder, "trees", rows, learning.FEATURES, f"{signed.rows}:{signed.digest}")
    row = saved_models.load(spark, folder, "trees")
    told = learning.recursive(boosting.Trees.from_json(row.model), series, month, HORIZON)
    return told.select("branch", "sku", F.lit(row.version).alias("version"), F.posexplode(F.transform("yhat", lambda v: F.bround(v, 4))).alias("h", "yhat"))


@register()
def served_forecast(spark, sf_dir):
    """The forecast of the candidate that does best on the last months, with its band."""
    return serving.served(_series(spark, sf_dir), _first_month(spark, sf_dir), HORIZON)[0]
