"""What keeps queries in proportion to their tables: lines read once, expressions made once, flat and bounded frames."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shelfline.operators import files, recode
from shelfline.plans import allocation_queries, entry_queries, file_queries, report_queries, stream_queries
from shelfline.streaming import jobs


def scans(frame, name, capsys):
    capsys.readouterr()
    frame.explain()
    return sum(f"{name}.parquet" in line and "Scan parquet" in line for line in capsys.readouterr().out.splitlines())


def test_file_names_are_split_once(spark):
    """A name was split again for each known branch, and lines were read for names, for panels and for what they cover."""
    branches = [(f"TOWN {i}", f"T{i}") for i in range(60)]
    said = files.sales_file(F.col("file"), branches, 2003)
    assert str(said["branch_code"]).count("upper(file)") < 5
    got = spark.createDataFrame([("MAY 2001 TOWN 12 SALES.csv",), ("TOWN 1 TOWN 12 JUNE.csv",), ("MAY 2001.csv",)], "file string").select(said["branch_code"].alias("code")).collect()
    assert [r.code for r in got] == ["T12", "T1", None]


def test_files_over_stored_reads_lines_once(spark, sf_dir, capsys):
    assert scans(file_queries.files_over_stored(spark, sf_dir), "lineitem", capsys) == 1


def test_series_of_forecasts_are_stored(spark, sf_dir):
    """Each fit and each step of a forecast read the lines again."""
    from shelfline.plans import learning_queries

    assert not any("lineitem" in f for f in learning_queries._series(spark, sf_dir).inputFiles())


def test_closed_back_orders_come_in_bounded_frames(monkeypatch):
    """All notes of a branch and all rows that they put out were held as objects at once."""
    monkeypatch.setattr(jobs, "ROWS_AT_ONCE", 2)
    notes = pd.DataFrame({"seq": [5, 1, 3, 2, 4], "close": [0, 0, 0, 0, 1], "week": [200102, 200101, 200101, 200101, 0], "products": [[9], [5, 6], [8, 5], [7], []], "qtys": [[1], [1, 1], [4, 2], [3], []]})
    for column in ("products", "qtys"):
        notes[column] = notes[column].map(lambda v: np.array(v, np.int64))
    held = {"open": {"bo_no": "BO-N-2000W52", "notes": 2, "short": {"5": 10}}, "used": {"BO-N-2000W52": 1}}
    frames = list(jobs.filled("N", iter([notes[:3], notes[3:]]), held))
    assert [len(f) for f in frames] == [2, 2]
    rows = pd.concat(frames)
    assert set(rows["bo_no"]) == {"BO-N-2000W52"} and set(rows["notes"]) == {5} and dict(zip(rows["product_id"], rows["qty_ordered"])) == {5: 13, 6: 1, 7: 3, 8: 4}
    assert held["open"] == {"bo_no": "BO-N-2001W02", "notes": 1, "short": {"9": 1}} and held["used"] == {"BO-N-2000W52": 1, "BO-N-2001W02": 1}
    assert list(jobs.filled("N", iter([notes[:0]]), held)) == [] and held["open"]["short"] == {"9": 1}


def test_stream_goes_on_over_many_loads(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(stream_queries, "LOAD_PLACES", 50)
    columns = ["branch_id", "bo_no", "notes", "product_id", "qty_ordered"]
    got = stream_queries.stream_closed_back_orders(spark, sf_dir).select(columns).collect()
    assert sorted(got) == sorted(entry_queries.accumulated_back_orders(spark, sf_dir).filter("not is_open").select(columns).collect()) and got


def test_weeks_of_the_training_set_do_not_move(spark, sf_dir, capsys):
    """A row for each series and week was joined twice and sorted; now weeks are made of the stored series at the end."""
    capsys.readouterr()
    report_queries.weekly_training_set(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [branch_id" not in plan and plan.count("Window [lead") == 0


def test_recoded_histories_read_lines_once(spark, sf_dir, capsys):
    """Lines were joined anew for codes, shares, names and months; whole months moved with each join."""
    frame = report_queries.relabelled_months(spark, sf_dir)
    assert scans(frame, "lineitem", capsys) == 0
    frame.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") <= 5


def test_rounds_of_chains_do_not_nest(spark):
    """The plan of a round held the plan of the round before twice; broadcasts of stored tables went by the size of their files."""
    merges = spark.createDataFrame([("x", i, i + 1, "branch") for i in range(40)], "branch string, old int, new int, basis string")
    found = recode.follow(merges)
    assert {(r.old, r.new) for r in found.collect()} == {(i, 40) for i in range(40)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 5000 and "InMemoryRelation" not in plan and "Broadcast" not in plan


def test_codes_of_keys_that_repeat(spark, sf_dir, tmp_path):
    """Each row of a part counts for its lines, as in the join; codes are made before parts are met."""
    for name in ("region", "nation", "customer", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf_dir}/{name}.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.unionByName(part.filter("p_partkey % 7 = 0")).write.parquet(str(tmp_path / "part.parquet"))
    units = lambda folder: {r.sku: r.qty for r in allocation_queries._codes(spark, folder).select("sku", F.inline("months")).groupBy("sku").agg(F.sum("qty").alias("qty")).collect()}
    once, twice = units(sf_dir), units(str(tmp_path))
    assert once and twice == {sku: qty * (2 if sku % 7 == 0 else 1) for sku, qty in once.items()}
