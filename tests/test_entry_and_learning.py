"""Streams against their batch forms, learned models against plain versions, files read from disk, reports written."""

import datetime
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.operators import allocation, entry, files, forecast, learning, panel, reports
from shelfline.streaming import jobs


def note(branch, seq, kind, day, shorts):
    return (branch, f"N{branch}", seq, kind, f"D{seq}", datetime.date(2001, 1, 1) + datetime.timedelta(days=day), [{"product_id": p, "qty": q} for p, q in shorts])


NOTES = [
    note(1, 1, "NOTE", 0, [(5, 2), (6, 1)]), note(1, 2, "NOTE", 1, [(5, 3)]), note(1, 3, "CLOSE", 1, []), note(1, 4, "NOTE", 2, [(7, 4)]), note(1, 5, "CLOSE", 3, []),
    note(1, 6, "NOTE", 9, []), note(1, 7, "NOTE", 10, [(5, 1)]), note(2, 1, "CLOSE", 0, []), note(2, 2, "NOTE", 4, [(5, 9)]), note(2, 3, "CLOSE", 30, []),
]
SCHEMA = "branch_id long, branch string, seq long, kind string, dn_no string, doc_date date, shorts array<struct<product_id:long,qty:long>>"


def test_accumulator_and_its_stream(spark, tmp_path):
    batch = entry.accumulated(spark.createDataFrame(NOTES, SCHEMA)).collect()
    want = {("BO-N1-2001W01", 2, False, 5, 5), ("BO-N1-2001W01", 2, False, 6, 1), ("BO-N1-2001W01-2", 1, False, 7, 4), ("BO-N1-2001W02", 2, True, 5, 1), ("BO-N2-2001W01", 1, False, 5, 9)}
    assert {(r.bo_no, r.notes, r.is_open, r.product_id, r.qty_ordered) for r in batch} == want
    source = str(tmp_path / "notes")
    for part in (NOTES[:4], NOTES[4:]):  # a file after another, so that state goes on
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    got = jobs.run_to_table(jobs.accumulate(stream), "accumulated").collect()
    assert {(r.bo_no, r.notes, r.product_id, r.qty_ordered) for r in got} == {(b, n, p, q) for b, n, open_, p, q in want if not open_}


def test_parts_of_months_come_as_a_stream(spark, tmp_path):
    schema = "branch string, period date, sku string, item string, qty long, turnover_cents long, day_from int, day_to int"
    month, source, target = datetime.date(2001, 3, 31), str(tmp_path / "in"), str(tmp_path / "table")
    loads = [
        [("A", month, "x", "one", 5, 50, 1, 12), ("B", month, "x", "one", 1, 10, 1, 12)], [("A", month, "x", "two", 7, 70, 13, 20), ("A", month, "y", "why", 2, 20, 13, 20)],
        [("A", month, "x", "late", 99, 99, 5, 9)], [("B", month, "z", "all", 8, 80, 1, 31)], [("A", month, "x", "gap", 9, 9, 25, 31)],
    ]
    for load in loads:
        spark.createDataFrame(load, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.merge_parts(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "c"))
    got = {(r.branch, r.sku, r.item, r.qty, r.turnover_cents, r.day_from, r.day_to) for r in spark.read.parquet(target).collect()}
    assert got == {("A", "x", "one", 12, 120, 1, 20), ("A", "y", "why", 2, 20, 1, 20), ("B", "z", "all", 8, 80, 1, 31)}


@pytest.mark.parametrize("record, parts, want", [
    (None, [(1, 10, 10), (5, 15, 7)], {("save,reject", 10, 1, 10)}), (None, [(1, 5, 4), (20, 25, 6)], {("save,reject", 4, 1, 5)}),
    ((8, 12, 3), [(1, 5, 4), (20, 25, 6)], {("reject,reject", 3, 8, 12)}), ((8, 12, 3), [(1, 7, 4), (13, 20, 6)], {("add,add", 13, 1, 20)}),
    ((8, 12, 3), [(13, 20, 6), (1, 31, 50), (2, 3, 9)], {("add,replace,skip", 50, 1, 31)}), ((8, 12, 3), [], {("keep", 3, 8, 12)}),
])
def test_parts_of_a_month_are_taken_one_after_another(spark, tmp_path, record, parts, want):
    schema = "branch string, period date, sku string, item string, qty long, turnover_cents long, day_from int, day_to int"
    row = lambda f, t, q: ("A", datetime.date(2001, 3, 1), "x", "X", q, q, f, t)
    old = spark.createDataFrame([row(*record)] if record else [], schema)
    new = spark.createDataFrame([(*row(*p), i) for i, p in enumerate(parts)], schema + ", part int")
    assert {(r.decision, r.qty, r.day_from, r.day_to) for r in entry.merged_month(old, new).collect()} == want
    # the same as files of one batch, each later than the one before
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    for i, p in enumerate(([record] if record else []) + parts):
        spark.createDataFrame([row(*p)], schema).coalesce(1).write.mode("append").parquet(source)
        for f in os.listdir(source):
            if f.endswith(".parquet") and os.path.getmtime(f"{source}/{f}") > 10_000:
                os.utime(f"{source}/{f}", (i, i))
    jobs.merge_parts(spark.readStream.schema(schema).parquet(source), target, str(tmp_path / "c"))
    assert {(r.qty, r.day_from, r.day_to) for r in spark.read.parquet(target).collect()} == {w[1:] for w in want}


def test_probes_share_what_is_left():
    assert allocation.probe_sizes(np.array([1.0, 1.0, 1.0]), 30, 0.0) == [10, 7, 4]
    assert allocation.probe_sizes(np.array([5.0, 1.0]), 9, 2.0) == [9]
    assert allocation.probe_sizes(np.array([0.0, 0.0]), 1, 0.0) == [1]


def test_stockouts_between_sales_are_lifted(spark):
    rows = [
        ("A", "gap", [20.0, 22, 18, 21, 0, 0, 0, 19, 20, 23, 18, 21], [None] * 4 + [0.0] * 3 + [None] * 5), ("A", "low", [0.0, 3, 0, 0, 2, 0, 0, 4, 0, 0, 1, 0], [None] * 12),
        ("A", "new", [0.0, 0, 0, 0, 0, 15, 17, 16, 18, 15, 19, 16], [0.0] * 5 + [None] * 7), ("A", "long", [20.0, 21, 19] + [0.0] * 10 + [22, 20, 21], [None] * 3 + [0.0] * 10 + [None] * 3),
    ]
    got = {r.sku: r for r in panel.uncensor(spark.createDataFrame([(b, s, [float(v) for v in y], h) for b, s, y, h in rows], "branch string, sku string, y array<double>, on_hand array<double>")).collect()}
    assert got["gap"].masked == [4 <= i <= 6 for i in range(12)] and got["gap"].level >= 15 and got["gap"].y[4:7] == [got["gap"].level] * 3
    assert not any(got["low"].masked) and got["low"].level == 0 and not any(got["new"].masked) and not any(got["long"].masked)


def series(spark, n=30, length=20, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("AB"[i % 2], f"s{i}", "cat" + str(i % 3), (rng.poisson(3, length) * (rng.random(length) < 0.3 + 0.02 * i)).astype(float).tolist()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "branch string, sku string, category string, y array<double>")


def test_levels_among_features(spark):
    rows, df = series(spark, 8)
    made = {(r.sku, int(r.t_idx)): r for r in learning.design(df, 3).collect()}
    for _, sku, _, y in rows:
        for t in range(4, len(y)):
            z = p = None
            q, past = 1.0, y[:t]
            for v in past:
                if v > 0:
                    z, p = (v, q) if z is None else (0.1 * v + 0.9 * z, 0.1 * q + 0.9 * p)
                    q = 1.0
                else:
                    q += 1
            r = made[sku, t]
            assert abs(r.croston - (0.95 * z / p if z else 0)) < 1e-9 and abs(r.damped - panel.damped_mean_of(np.array(past))) < 1e-9 and r.target == y[t] and r.month == (3 + t - 1) % 12 + 1
    assert len(made) == sum(len(y) - 4 for *_, y in rows)


@pytest.mark.parametrize("fit", [learning.fit_trees, learning.fit_tweedie, learning.fit_ratio])
def test_models_tell_without_seeing_ahead(spark, fit):
    _, df = series(spark)
    ratio = fit is learning.fit_ratio
    model = fit(learning.design(df, 1))
    told = {(r.branch, r.sku): r.yhat for r in learning.recursive(model, df, 1, 3, ratio).collect()}
    assert len(told) == 30 and all(len(v) == 3 and min(v) >= 0 and np.isfinite(v).all() for v in told.values())
    first = learning.recursive(model, df, 1, 1, ratio).collect()
    assert all(abs(told[r.branch, r.sku][0] - r.yhat[0]) < 1e-9 for r in first)  # later steps don't change earlier ones


def test_origins_are_told_from_before(spark):
    rows, df = series(spark, 6)
    got = {(r.origin, r.sku, r.model): (r.yhat, r.actual) for r in learning.rolling_origins(df.select("branch", "sku", "y"), 3).collect()}
    assert len(got) == 3 * 6 * 5
    for origin, (branch, sku, _, y) in itertools.product((1, 2, 3), rows):
        cut = spark.createDataFrame([(branch, sku, y[:-origin])], "branch string, sku string, y array<double>")
        if origin == 2:
            for r in forecast.model_levels(cut, 1).collect():
                assert abs(got[origin, sku, r.model][0] - r.yhat[0]) < 1e-9
        assert all(got[origin, sku, m][1] == y[-origin] for m in forecast.MODELS)


def test_fitted_blend_is_no_worse_than_any_model_or_mean(spark):
    rng = np.random.default_rng(4)
    actual = rng.poisson(20, 300).astype(float)
    models = {"low": actual * 0.8 + rng.normal(0, 2, 300), "high": actual * 1.3 + rng.normal(0, 2, 300), "noise": rng.uniform(0, 60, 300)}
    told = spark.createDataFrame([(1, "A", str(i), m, float(v[i]), float(actual[i])) for m, v in models.items() for i in range(300)], "origin int, branch string, sku string, model string, yhat double, actual double")
    weights = learning.fit_blend(told, list(models))
    matrix = np.stack(list(models.values()), 1)

    def loss(w):
        gap = matrix @ w - actual
        return learning.loss(np.abs(gap).sum(), gap.sum(), actual.sum())

    best = loss(np.array([weights.get(m, 0.0) for m in models]))
    others = [*np.eye(3), np.full(3, 1 / 3), *rng.dirichlet(np.ones(3), 300)]
    assert abs(sum(weights.values()) - 1) < 0.01 and best <= min(map(loss, others)) + 0.003


def test_choice_of_a_model(spark):
    table = spark.createDataFrame([("a", 20.0, -20.0), ("b", 22.0, 12.0), ("c", 22.5, 6.0), ("snaive", 23.0, 4.0), ("dead", 10.0, 5.0), ("far", 40.0, 5.0)], "model string, wape double, bias double")
    dead = spark.createDataFrame([("dead", 0.2), ("a", 0.1)], "model string, dead double")
    assert learning.chosen(table, dead).first().model == "snaive"  # as near to +5 as c, and it moves
    assert learning.chosen(table, dead, "far").first().model == "far" and learning.chosen(table, dead, "unknown").first().model == "snaive"
    assert learning.chosen(table.filter("model in ('a', 'dead')"), dead).first().model == "a"


def test_uplift_and_categories(spark):
    cells = lambda *rows: spark.createDataFrame(rows, "a double, f double")
    assert abs(learning.uplift(cells((10.0, 8.0), (10.0, 8.0))).first().uplift - 1.3125) < 1e-9
    assert learning.uplift(cells((1.0, 9.0))).first().uplift == 1.0 and learning.uplift(cells((9.0, 1.0))).first().uplift == 2.5
    rows = [("A", f"s{i}", "x", 10.0 * m, 10.0) for i, m in enumerate((1.0, 2.0, 4.0))] + [("A", "alone", "y", 30.0, 10.0), ("A", "none", "x", 5.0, 0.0)]
    got = {r.sku: r.yhat for r in learning.category_pooled(spark.createDataFrame(rows, "branch string, sku string, category string, yhat double, level double")).collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {"s0": 12.0, "s1": 20.0, "s2": 36.0, "alone": 30.0, "none": 5.0}


def test_files_from_disk(spark, tmp_path):
    folder = tmp_path / "monthly"
    folder.mkdir()
    (folder / "JULY 2025 GWANDA THOBELANI 5-20 SALES.csv").write_text("Item No,Name,Qty,GP %,Turnover,Profit\nA1,HEX BOLT,3,10,30,3\nA1,BOLT,2,20,20,\n,Total,5,,50,\n")
    (folder / "MAY GWANDA.csv").write_text("Item No,Name,Qty\nB2,PVC PIPE,x\n")
    (folder / "NOTES.csv").write_text("Item No,Name,Qty\nB2,PVC PIPE,1\n")
    cells = files.read_cells(spark, str(folder / "*.csv"), 6)
    got = {tuple(r)[:9] + (r.category,) for r in files.monthly_panel(cells, [("GWANDA", "GWA"), ("GWANDA THOBELANI", "GWT")], 2024).select("branch_code", "sku", "period", "item", "qty", "turnover", "profit", "day_from", "day_to", "category").collect()}
    assert got == {("GWT", "A1", datetime.date(2025, 7, 31), "HEX BOLT", 5.0, 50.0, 3.0, 5, 20, "Fasteners"), ("GWA", "B2", datetime.date(2024, 5, 31), "PVC PIPE", 0.0, 0.0, 0.0, 1, 31, "Pumps & Water")}


def test_bundles_are_written(spark, tmp_path):
    frame = spark.createDataFrame([("A", 1), ("B", 2)], "branch string, n int")
    reports.write_bundle({"one": frame, "two": frame.limit(1)}, str(tmp_path / "x"), csv=True, by="branch")
    back = spark.read.option("header", True).csv(str(tmp_path / "x" / "one"))
    assert {(r.branch, r.n) for r in back.collect()} == {("A", "1"), ("B", "2")}


def test_numbers_json_has(spark):
    rows = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r.v for r in rows.select(reports.finite(F.col("v")).alias("v")).collect()] == [1.5, None, None, None]


def test_products_are_split_whole_over_batches(spark):
    """Products whose rows two batches share, without a data frame for each product."""
    rows = [(p, b, float(p * b % 5), 3, b % 2, float(b), 40) for p in range(30) for b in range(7)]
    df = spark.createDataFrame(rows, "product_id long, branch_id long, rate double, weeks_sold long, on_hand long, branch_size double, qty long")
    whole = sorted(map(tuple, allocation.split_product(df).collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        cut = allocation.split_product(df)
        assert sorted(map(tuple, cut.collect())) == whole and len(whole) == 210
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert "FlatMapGroupsInPandas" not in cut._jdf.queryExecution().executedPlan().toString()
    assert all(sum(r[2] for r in whole if r[0] == p) + next(r[4] for r in whole if r[0] == p) == 40 for p in range(30))
    assert allocation.split_product(df.limit(0)).count() == 0
