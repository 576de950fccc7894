"""Rules of single figures against plain versions: quantiles, dry spells, back-tests over the union of keys, summaries."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from shelfline.functions import scalar
from shelfline.operators import forecast, panel, planning, reports, running, sales


def day(m, d=1):
    return datetime.date(2020 + (m - 1) // 12, (m - 1) % 12 + 1, d)


def test_quantiles_by_level(spark):
    levels = [0.8, 0.9, 0.95, 0.975, 0.9749999, 0.99, 0.5, None]
    df = spark.createDataFrame([(v,) for v in levels], "level double").select("level", scalar.z_score(F.col("level"), scalar.Z_ORDERS).alias("o"), scalar.z_score(F.col("level"), scalar.Z_BANDS).alias("b"))
    assert [(r.o, r.b) for r in df.collect()] == [(1.6449, 0.84), (1.2816, 1.28), (1.6449, 1.645), (1.96, 1.96), (1.96, 1.96), (2.3263, 2.33), (1.6449, 1.645), (1.6449, 1.645)]


@pytest.mark.parametrize("days,limit", [([], 8), ([0], 8), ([0, 0], 8), ([0, 7, 14], 8), ([0, 31, 59, 90], 2), ([0, 14], 4), ([0, 16], 4), ([0, 112], 1), ([0, 400], 1), ([0, 1], 56)])
def test_dry_spells_scale_with_the_gap(spark, days, limit):
    periods = spark.createDataFrame([(day(1) + datetime.timedelta(d),) for d in days], "period date")
    assert [r.limit for r in panel.dry_run_limit(periods).collect()] == [limit]


def plain_point(q):
    sold = [v for v in q if v > 0]
    weights = [0.55 ** (len(q) - 1 - i) for i in range(len(q))]
    if not sold:
        raw = 0.0
    elif len(sold) == 1 and q[-1] > 0:
        raw = 0.6 * q[-1]
    elif q[-1] == 0:
        raw = 0.35 * sum(sold) / len(sold)
    else:
        raw = sum(w * v for w, v in zip(weights, q)) / sum(weights)
    return round(raw * 1.05 + 1e-9, 4)


def test_backtest_over_the_union_of_keys(spark):
    rng = random.Random(3)
    rows = [(b, f"s{s}", day(m), rng.randrange(0, 9)) for b in "xy" for s in range(12) for m in range(1, 10) if rng.random() < 0.5 and (s != 3 or m == 9) and (s != 4 or m < 9)]
    rows += [("x", "s3", day(9), 4), ("z", "gone", day(2), 5)]  # known to one side only; a branch without anything sold at the end
    held = {}
    for b, s, p, q in rows:
        held.setdefault((b, s), {}).setdefault(p, 0)
        held[b, s][p] += q
    cells = {}
    for key, by in held.items():
        q = [by.get(day(m), 0) for m in range(3, 9)]
        known = any(p < day(9) for p in by)
        cells[key] = (plain_point(q) if known else 0.0, q[-1] if known else 0, sum(q) / 6 if known else 0, by.get(day(9), 0))
    got = {r.scope: r for r in forecast.union_backtest(spark.createDataFrame(rows, "branch string, sku string, period date, qty long")).collect()}
    assert set(got) == {"x", "y", "z", "all"} and got["z"].wape_pct is None and got["z"].skill_vs_last_pct is None
    for scope in ("x", "y", "all"):
        c = [v for k, v in cells.items() if scope in (k[0], "all")]
        total = sum(a for *_, a in c)
        off = [sum(abs(v[i] - v[3]) for v in c) for i in range(3)]
        wape = round(100 * off[0] / total, 1)
        want = (sum(f > 0 or a > 0 for f, _, _, a in c), wape, off[0] / len(c), 100 * sum(f - a for f, _, _, a in c) / total, 100 * (1 - wape / (100 * off[1] / total)), 100 * (1 - wape / (100 * off[2] / total)))
        r = got[scope]
        assert (r.series, r.wape_pct) == want[:2]
        assert (r.mae, r.bias_pct, r.skill_vs_last_pct, r.skill_vs_mean_pct) == pytest.approx(want[2:], abs=0.051)


def test_branch_summary_counts_days_of_parts(spark):
    rows = [("x", "a", day(1), 310, 1, 1, 31), ("x", "a", day(2), 290, 1, 1, 29), ("x", "a", day(3), 100, 1, 1, 10), ("x", "b", day(3), 20, 1, 1, 10), ("y", "a", day(3), 5, 1, 1, 31)]
    df = spark.createDataFrame(rows, "branch string, sku string, period date, qty long, turnover_cents long, day_from int, day_to int")
    got = {r.branch: r for r in sales.branch_summary(df).collect()}
    assert (got["x"].trend_pct, got["x"].distinct_skus, got["x"].avg_monthly_qty, got["x"].latest_month_partial) == (20.0, 2, 240.0, True)
    assert (got["y"].trend_pct, got["y"].months, got["y"].latest_month_partial) == (0.0, 1, False)


def test_flow_summary_of_profit_and_without(spark):
    rows = [("x", "a", day(1), 1, 100, 50), ("x", "b", day(2), 9, 100, -10), ("y", "a", day(2), 2, 200, 20)]
    df = spark.createDataFrame(rows, "branch string, sku string, period date, qty long, turnover_cents long, profit_cents long")
    r = sales.flow_summary(df).first()
    assert (r.qty_now, r.qty_before, r.margin_pct, r.top_branch, r.top_branch_pct, r.top_sku, r.top_sku_pct) == (11, 1, 15.0, "x", 83.3, "b", 75.0)
    assert (r.top_profit_sku, r.top_profit_sku_profit_cents, r.top_profit_sku_pct) == ("a", 70, 116.7)
    r = sales.flow_summary(df.drop("profit_cents")).first()
    assert (r.margin_pct, r.top_profit_sku, r.top_sku) == (None, None, "b")


def test_what_to_reorder_first(spark):
    rows = [(1, 1, "ok", 2.0), (1, 2, "reorder", 9.0), (2, 1, "out", 0.0), (2, 2, "ok", None), (3, 1, "ok", 1.0)]
    got = planning.first_to_reorder(spark.createDataFrame(rows, "branch_id int, product_id int, status string, days_left double"), 4).orderBy("place").collect()
    assert [(r.branch_id, r.product_id, r.place) for r in got] == [(2, 1, 1), (1, 2, 2), (3, 1, 3), (1, 1, 4)]
    assert {(r.products, r.to_reorder) for r in got} == {(5, 2)}


def test_last_months_beside_each_other(spark):
    rows = [("x", "a", "old", "c1", day(1), 5, 50), ("x", "a", "new", "c2", day(3), 1, 9), ("x", "b", "bb", "c", day(2), 0, 7), ("x", "z", "gone", "c", day(0 + 1), 4, 4), ("x", "q", "qq", "c", day(4), 3, 10)]
    df = spark.createDataFrame(rows, "branch string, sku string, item string, category string, period date, qty long, turnover_cents long")
    got = {r.sku: (r.q1, r.q2, r.q3, r["item"], r.category, r.unit_price_cents) for r in panel.matrix(df).collect()}
    assert got == {"a": (0, 1, 0, "new", "c2", 9.0), "b": (0, 0, 0, "bb", "c", None), "q": (0, 0, 3, "qq", "c", 3.3333)}


def test_halves_of_a_summary_are_those_of_exact_sums(spark):
    # added as doubles, 0.7 + 0.1 + 0.7 is below one and a half, and 0.015 comes out as less
    rows = [("x", "growing", "Low", 0.007, 0.7), ("x", "new", "High", 0.001, 0.1), ("x", "new", "High", 0.007, 0.7)]
    df = spark.createDataFrame(rows, "branch string, pattern string, confidence string, point double, value_cents double").coalesce(1)
    r = reports.forecast_summary(df).first()
    assert (r.series, r.growing, r.new, r.high, r.units, r.value_cents) == (3, 1, 2, 2, 0.02, 2.0)


def test_last_months_are_told_without_a_row_for_each_month(spark):
    rng = random.Random(4)
    rows = [(b, f"s{i}", day(m), rng.randrange(0, 9)) for b in "xy" for i in range(12) for m in (1, 2, 4, 7, 8, 9, 10, 12) if rng.random() < 0.5] + [("x", "late", day(12), 3), ("y", "early", day(1), 5)]
    history = spark.createDataFrame(rows, "branch string, sku string, period date, qty long")
    past = history.filter(F.col("period") < day(12))
    series = panel.as_arrays(panel.densify(past)).withColumn("y", panel.tail(F.col("y"), 6))
    points = {(r.branch, r.sku): r.point for r in forecast.monthly_forecast(series).collect()}
    actual = {(b, s): q for b, s, p, q in rows if p == day(12)}
    pairs = [(points.get(k, 0.0), actual.get(k, 0)) for k in points.keys() | actual.keys()]
    result = forecast.union_backtest(history)
    assert "Generate" not in result._jdf.queryExecution().executedPlan().toString()
    got = {r.scope: r for r in result.collect()}
    assert got["all"].series == sum(a > 0 or f > 0 for f, a in pairs) and ("late" in {s for _, s in actual}) and set(got) == {"all", "x", "y"}
    assert got["all"].wape_pct == pytest.approx(100 * sum(abs(f - a) for f, a in pairs) / sum(a for _, a in pairs), abs=0.06)
    only = forecast.union_backtest(history.filter(F.col("period") == day(12))).filter("scope = 'all'").first()
    assert only.wape_pct == 100.0 and only.skill_vs_last_pct == 0.0
    assert forecast.union_backtest(history.limit(0)).count() == 0


def test_rows_of_a_frequent_value_get_their_rank_where_they_are(spark):
    values = [0] * 3000 + [None] * 2500 + list(range(1, 400)) + [7, 7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long").repartition(8)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("false", "-1")):
        spark.conf.set(k, v)
    try:
        got = running.average_rank(df, "v", "twice").withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    order = sorted(values, key=lambda v: (v is not None, v or 0))
    first = {v: order.index(v) for v in set(values)}
    assert {r.id: r.twice for r in got} == {i: 2 * first[v] + values.count(v) + 1 for i, v in enumerate(values)}
    for v in (0, None):
        tasks = [r.task for r in got if r.v == v]
        assert max(map(tasks.count, set(tasks))) < len(tasks)
