"""Loads that run again, tables rebuilt by signature, and months laid over weeks, on small cases."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from shelfline.operators import weeks
from shelfline.streaming import loads

D = datetime.date
ROW = "branch string, period date, sku string, qty long"


def put(spark, folder, name, rows, schema=ROW):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{name}")


def run(spark, folder, then=None, simulated=False, checkpoint="c"):
    loads.load_once(spark, f"{folder}/in", ROW, f"{folder}/t", ["branch", "period"], f"{folder}/{checkpoint}", simulated, then)


def rows(spark, folder, simulated=False):
    return sorted((r.branch, r.period.month, r.sku, r.qty) for r in loads.table_of(spark, f"{folder}/t", ROW).filter(F.col("simulated") == simulated).collect())


def written(folder):
    return sorted((os.path.join(d, f), os.path.getmtime(os.path.join(d, f))) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


JAN, FEB = D(2001, 1, 1), D(2001, 2, 1)


def test_a_load_that_was_cut_off_is_done_again_and_no_other(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    put(spark, folder, 1, [("a", JAN, "x", 1), ("a", JAN, "y", 2), ("b", JAN, "x", 3), ("a", FEB, "x", 4)])
    ran = []

    def cut(keys, number):
        ran.append(number)
        if len(ran) == 1:
            raise RuntimeError("cut off between data and record")

    with pytest.raises(Exception, match="cut off"):
        run(spark, folder, cut)
    assert not os.path.exists(f"{folder}/t/loads")
    run(spark, folder, cut)
    whole = [("a", 1, "x", 1), ("a", 1, "y", 2), ("a", 2, "x", 4), ("b", 1, "x", 3)]
    assert rows(spark, folder) == whole and len(ran) == 2
    # the same file once more under another checkpoint, as after a lost one: nothing is written
    before = written(f"{folder}/t")
    run(spark, folder, cut, checkpoint="c2")
    assert written(f"{folder}/t") == before and rows(spark, folder) == whole
    # the next load replaces its months only
    put(spark, folder, 2, [("a", JAN, "z", 9)])
    run(spark, folder)
    assert rows(spark, folder) == [("a", 1, "z", 9), ("a", 2, "x", 4), ("b", 1, "x", 3)]
    assert spark.read.parquet(f"{folder}/t/loads").count() == 2


def test_replays_do_not_bring_back_what_was_replaced(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, 1, [("a", JAN, "x", 1)])
    run(spark, folder)
    put(spark, folder, 2, [("a", JAN, "x", 2)])
    run(spark, folder)
    first = next(d for d, _, fs in os.walk(f"{folder}/in/1") for f in fs if f.endswith(".parquet"))
    name = next(f for f in os.listdir(first) if f.endswith(".parquet"))
    os.makedirs(f"{folder}/in/3")
    with open(f"{first}/{name}", "rb") as old, open(f"{folder}/in/3/{name}", "wb") as again:
        again.write(old.read())
    run(spark, folder)
    assert rows(spark, folder) == [("a", 1, "x", 2)]


def test_loads_of_one_batch_and_simulated_rows(spark, tmp_path):
    folder = str(tmp_path)
    put(spark, folder, 1, [("a", JAN, "x", 1)])
    for d, _, fs in os.walk(f"{folder}/in/1"):
        for f in fs:
            os.utime(os.path.join(d, f), (1, 1))
    put(spark, folder, 2, [("a", JAN, "x", 2), ("a", JAN, "x", 2), ("a", FEB, None, None)])
    run(spark, folder)  # both in one batch: of the same keys the later file counts
    assert [(b, m, s, q) for b, m, s, q in rows(spark, folder) if s] == [("a", 1, "x", 2)] * 2
    run(spark, folder, simulated=True, checkpoint="c2")
    assert rows(spark, folder, True) == []  # they are on record
    put(spark, folder, 4, [("a", JAN, "s", 7)])
    run(spark, folder, simulated=True, checkpoint="c3")
    assert rows(spark, folder, True) == [("a", 1, "s", 7)]
    assert [r for r in rows(spark, folder) if r[2]] == [("a", 1, "x", 2)] * 2


def test_refresh_builds_what_differs_and_nothing_else(spark, tmp_path):
    target = f"{tmp_path}/t"
    table = lambda rs: spark.createDataFrame(rs, ROW).repartition(3)
    built = []

    def build(some):
        built.append({r.period for r in some.select("period").distinct().collect()})
        return some.groupBy("period").agg(F.sum("qty").alias("qty"))

    first = [("a", JAN, "x", 1), ("a", JAN, "x", 1), ("a", FEB, "x", 2), ("b", FEB, None, 3)]
    assert loads.refresh(table(first), ["period"], build, target) == 1
    before = written(target)
    assert loads.refresh(table(first[::-1]), ["period"], build, target) == 1
    assert written(target) == before and len(built) == 1
    assert loads.refresh(table(first[1:]), ["period"], build, target) == 2  # of two equal rows one is gone
    assert built == [{JAN, FEB}, {JAN}]
    assert loads.refresh(table([("a", JAN, "x", 1), ("a", FEB, "x", 2), ("b", FEB, "", 3)]), ["period"], build, target) == 3  # null is not empty
    assert built[-1] == {FEB}
    assert loads.refresh(table([("a", JAN, "x", 1)]), ["period"], build, target) == 4
    assert [(r.period, r.qty, r.built) for r in loads.refreshed(spark, target, ["period"]).collect()] == [(JAN, 1, 2)]
    assert len(built) == 3


def test_days_of_real_weeks_are_left_out_and_the_rate_stays(spark):
    months = spark.createDataFrame([("a", D(2001, 5, 1), 1, 31, "x", "X", 310, 3100), ("a", D(2001, 6, 1), 1, 12, "x", "X", 120, 1200), ("b", D(2001, 5, 1), 1, 31, "y", "Y", 0, 0)], "branch string, period date, day_from int, day_to int, sku string, item string, qty long, turnover_cents long")
    real = spark.createDataFrame([("a", D(2001, 5, 16)), ("b", D(2001, 5, 7))], "branch string, week_start date")  # a Wednesday
    got = {r.week_start: (r.qty, r.turnover) for r in weeks.simulated_weeks(months, real).collect()}
    # ten a day; 16 to 22 May are covered; the week from 28 May has four days of May and three of June
    want = {D(2001, 4, 30): 60, D(2001, 5, 7): 70, D(2001, 5, 14): 20, D(2001, 5, 21): 50, D(2001, 5, 28): 70, D(2001, 6, 4): 70, D(2001, 6, 11): 20}
    assert got == {w: (float(q), float(q) / 10) for w, q in want.items()}
    assert weeks.simulated_weeks(months.limit(0), real).count() == 0
    assert sum(r.qty for r in weeks.simulated_weeks(months, real.limit(0)).collect()) == 430


def test_a_real_week_makes_only_its_months_anew(spark, tmp_path):
    folder = str(tmp_path)
    month = lambda p, q: ("a", p, "x", "X", q, q * 100, 1, 31)
    put(spark, folder, "m1", [month(D(2001, m, 1), 300) for m in (1, 2, 3, 4, 5, 6)], loads.MONTHS)
    loads.load_months(spark, f"{folder}/in", f"{folder}/t", f"{folder}/cm")
    stamps = lambda: {p.split("month=")[1][:7]: t for p, t in written(f"{folder}/t/weeks")}
    before = stamps()
    spark.createDataFrame([("a", D(2001, 4, 9), "x", "X", 5.0, 1.0, D(2001, 4, 1))], f"{loads.WEEKS}, month date").coalesce(1).write.parquet(f"{folder}/weeks/1")
    loads.load_weeks(spark, f"{folder}/weeks", f"{folder}/t", f"{folder}/cw")
    after = stamps()
    assert {m for m in after if after[m] != before.get(m)} == {"2001-03", "2001-04", "2001-05"}
    real = spark.createDataFrame([("a", D(2001, 4, 9), "x", "X", 5.0, 1.0)], loads.WEEKS)
    months = loads.table_of(spark, f"{folder}/t/months", loads.MONTHS).drop("load", "simulated")
    plain = lambda df: sorted((r.branch, r.week_start, r.sku, r.qty, r.turnover, r.simulated) for r in df.collect())
    assert plain(loads.weeks_of(spark, f"{folder}/t")) == plain(weeks.weekly_table(months, real))
