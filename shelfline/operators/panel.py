"""Series panels: densifying, calendar alignment, apportioning, and per-series statistics on arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the demand statistics.
RECENT_PERIODS, RECENT_WEIGHT, INFLUENCE, PEAK_CEILING = 6, 2.0, 0.75, 3.0
ANCHOR_PERIODS, DEAD_PERIODS, DRY_WEEKS = 8, 6, 8
ADI_CUT, CV2_CUT = 1.32, 0.49
LOW, HEURISTIC_LOW, HEURISTIC_RATE, LEAST_LEVEL, MOST_CENSORED = 0.6, 0.25, 0.5, 2.0, 0.5


def densify(panel: DataFrame) -> DataFrame:
    """Every series on every month between the first and the last, absent cells 0, t counting from 1."""
    calendar = panel.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).select(F.posexplode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("t", "period"))
    grid = panel.select("branch", "sku").distinct().join(F.broadcast(calendar))  # the calendar has a row for each month
    sums = panel.groupBy("branch", "sku", "period").agg(F.sum("qty").alias("qty"))
    return grid.join(sums, ["branch", "sku", "period"], "left").select("branch", "sku", (F.col("t") + 1).alias("t"), "period", F.coalesce("qty", F.lit(0).cast("long")).alias("qty"))


def as_arrays(dense: DataFrame) -> DataFrame:
    """One row for each series: its values in order of time as y."""
    ordered = F.array_sort(F.collect_list(F.struct("t", "qty")))
    return dense.groupBy("branch", "sku").agg(F.transform(ordered, lambda x: x["qty"].cast("double")).alias("y"))


def segments(dense: DataFrame) -> DataFrame:
    """Smooth, erratic, intermittent, lumpy, new or dead, by the mean gap between sales and the squared variation."""
    sold = F.when(F.col("qty") > 0, F.col("qty"))
    sums = dense.groupBy("branch", "sku").agg(F.count(F.lit(1)).alias("n"), F.count(sold).alias("nnz"), F.sum(sold).alias("s"), F.sum(sold * sold).alias("s2"))
    adi = F.col("n") / F.col("nnz")
    cv2 = (F.col("s2") * F.col("nnz") - F.col("s") * F.col("s")) / (F.col("s") * F.col("s"))  # population variance over squared mean
    label = (
        F.when(F.col("nnz") == 0, "dead").when(F.col("nnz") == 1, "new")
        .when((adi >= ADI_CUT) & (cv2 >= CV2_CUT), "lumpy").when(adi >= ADI_CUT, "intermittent").when(cv2 >= CV2_CUT, "erratic").otherwise("smooth")
    )
    return sums.select("branch", "sku", "nnz", F.bround(adi, 4).alias("adi"), F.bround(cv2, 4).alias("cv2"), label.alias("segment"))


def dry_run_limit(periods: DataFrame) -> DataFrame:
    """limit: how many of these periods (column period, repeats count once) make up the longest dry spell that still is a
    stockout, eight weeks; at least one, and eight where no gap between periods is known. One row."""
    ends = periods.agg(F.countDistinct("period").alias("n"), F.datediff(F.max("period"), F.min("period")).alias("days"))
    scaled = F.greatest(F.lit(1), F.bround(DRY_WEEKS * 7 * (F.col("n") - 1) / F.col("days"), 0).cast("int"))
    return ends.select(F.when(F.col("days") > 0, scaled).otherwise(DRY_WEEKS).alias("limit"))


def matrix(history: DataFrame, months: int = 3) -> DataFrame:
    """Of each series the units of the last periods as columns q1 (the oldest) and on, 0 where there are none, its last item
    and category in these, and its turnover a unit, null without units. history: branch, sku, item, category, period,
    qty, turnover_cents."""
    ranked = history.select("period").distinct().withColumn("__back", F.row_number().over(Window.orderBy(F.desc("period")))).filter(F.col("__back") <= months)  # few rows
    recent = history.join(F.broadcast(ranked), "period")
    cells = [F.coalesce(F.sum(F.when(F.col("__back") == months - i, F.col("qty"))), F.lit(0).cast("long")).alias(f"q{i + 1}") for i in range(months)]
    last = lambda c: F.max_by(c, F.struct("period", c)).alias(c)
    sums = recent.groupBy("branch", "sku").agg(*cells, last("item"), last("category"), F.sum("qty").alias("__units"), F.sum("turnover_cents").alias("__cents"))
    return sums.withColumn("unit_price_cents", F.when(F.col("__units") > 0, F.bround(F.col("__cents") / F.col("__units"), 4))).drop("__units", "__cents")


def median_of(values: Column) -> Column:
    ordered, n = F.array_sort(values), F.size(values)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def tail(values: Column, n: int) -> Column:
    have = F.least(F.size(values), F.lit(n))
    return F.slice(values, F.size(values) - have + 1, have)


def damped_mean(series: DataFrame, column: str, out: str, recent: int = RECENT_PERIODS) -> DataFrame:
    """Adds the recency-weighted mean of an array with spikes pulled to the body: above median + 2 MAD only a share of the
    excess counts, and with three or more sales no value counts more than a multiple of a typical sale."""
    y = F.col(column)
    s = series.withColumn("__med", median_of(y))
    s = s.withColumn("__mad", median_of(F.transform(y, lambda v: F.abs(v - F.col("__med")))))
    s = s.withColumn("__cap", F.col("__med") + 2 * F.when(F.col("__mad") > 0, F.col("__mad")).otherwise(F.greatest(F.col("__med") * 0.5, F.lit(1.0))))
    sold, late = F.filter(y, lambda v: v > 0), F.filter(tail(y, recent), lambda v: v > 0)
    typical = F.when(F.size(late) >= 3, median_of(late)).otherwise(median_of(sold))
    s = s.withColumn("__top", F.when(F.size(sold) >= 3, F.greatest(F.col("__cap"), PEAK_CEILING * typical)))
    damped = lambda v: F.when(v > F.col("__cap"), F.col("__cap") + INFLUENCE * (v - F.col("__cap"))).otherwise(v)
    first = F.size(y) - F.least(F.size(y), F.lit(recent))
    weighted = F.transform(y, lambda v, i: F.coalesce(F.least(damped(v), F.col("__top")), damped(v)) * F.when(i >= first, RECENT_WEIGHT).otherwise(1.0))
    weights = first + RECENT_WEIGHT * F.least(F.size(y), F.lit(recent))
    total = F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)
    level = F.when(F.exists(y, lambda v: v > 0), total / weights).otherwise(F.lit(0.0))
    return s.withColumn(out, level).drop("__med", "__mad", "__cap", "__top")


def recent_level(series: DataFrame, column: str, out: str) -> DataFrame:
    """The damped mean of the last eight periods, 0 after six without a sale."""
    s = damped_mean(series.withColumn("__last", tail(F.col(column), ANCHOR_PERIODS)), "__last", out)
    return s.withColumn(out, F.when(F.exists(tail(F.col(column), DEAD_PERIODS), lambda v: v > 0), F.col(out)).otherwise(F.lit(0.0))).drop("__last")


def nearest_period(readings: DataFrame, day: str, periods: list, tolerance: int) -> DataFrame:
    """Adds the period nearest to a day within the tolerance (ties: the earlier), else null; periods are few."""
    known = F.array(*(F.lit(p) for p in periods))
    best = F.array_min(F.transform(known, lambda p: F.struct(F.abs(F.datediff(F.col(day), p)).alias("gap"), p.alias("period"))))
    return readings.withColumn("__best", best).withColumn("period", F.when(F.col("__best.gap") <= tolerance, F.col("__best.period"))).drop("__best")


def months_to_weeks(monthly: DataFrame, value: str, covered: DataFrame | None = None) -> DataFrame:
    """Splits monthly values over the weeks (from Monday) that they overlap, by days; days of weeks that are covered by
    real readings get none, while the divisor stays the whole month. Weeks without a positive value are left out."""
    first, last = F.col("period"), F.last_day("period")
    monday = F.date_trunc("week", first).cast("date")
    weeks = monthly.withColumn("week_start", F.explode(F.sequence(monday, F.date_trunc("week", last).cast("date"), F.expr("interval 7 days"))))
    if covered is not None:
        weeks = weeks.join(F.broadcast(covered.select("week_start")), "week_start", "left_anti")
    days = F.datediff(F.least(F.date_add("week_start", 6), last), F.greatest(F.col("week_start"), first)) + 1
    share = F.col(value) * days / (F.datediff(last, first) + 1)
    return weeks.groupBy("branch", "sku", "week_start").agg(F.bround(F.sum(share), 2).alias(value)).filter(F.col(value) > 0)


def merge_decision(old_from: Column, old_to: Column, new_from: Column, new_to: Column) -> Column:
    """What to do with a part-month upload: save, replace, skip, add or reject."""
    return (
        F.when(old_from.isNull(), "save")
        .when((new_from <= old_from) & (new_to >= old_to), "replace")
        .when((new_from >= old_from) & (new_to <= old_to), "skip")
        .when((new_from == old_to + 1) | (new_to == old_from - 1), "add")
        .otherwise("reject")
    )


def stockout_mask(y: np.ndarray, on_hand: np.ndarray, heuristic: bool = True, longest: int = 8) -> tuple[np.ndarray, float]:
    """Periods of a series in which it was probably out of stock, and its level when in stock. on_hand is nan where there
    is no reading. Only low periods between the first and last sale count: with a reading of 0, or without a reading if
    very low with sales close by on both sides. Runs over `longest` and masks of over half of all periods are undone."""
    mask, sales = np.zeros(len(y), bool), np.flatnonzero(y > 0)
    known = np.isfinite(on_hand)
    out = known & (np.where(known, on_hand, 1) <= 0)
    if len(sales) < 3:
        return mask, 0.0
    span = np.arange(sales[0], sales[-1] + 1)
    stocked = y[span[~out[span]]]
    if len(stocked) < 3 or (stocked > 0).mean() < HEURISTIC_RATE:
        return mask, 0.0
    level = damped_mean_of(stocked)
    if level < LEAST_LEVEL:
        return mask, 0.0
    sold = np.pad(y > 0, 2)
    near = (sold[:-4] | sold[1:-3]) & (sold[3:-1] | sold[4:])
    inner = np.zeros(len(y), bool)
    inner[sales[0] + 1 : sales[-1]] = True
    mask = inner & (y < LOW * level) & (out | (heuristic & ~known & (y < HEURISTIC_LOW * level) & near))
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(int), 0]))
    for a, b in zip(edges[::2], edges[1::2]):
        if b - a > longest:
            mask[a:b] = False
    if mask.sum() > MOST_CENSORED * len(y):
        mask[:] = False
    return mask, level


def damped_mean_of(y: np.ndarray, recent: int = RECENT_PERIODS) -> float:
    """damped_mean() of one numpy series."""
    if not len(y) or not y.any():
        return 0.0
    middle = np.median(y)
    mad = np.median(np.abs(y - middle))
    cap = middle + 2 * (mad if mad > 0 else max(middle * 0.5, 1.0))
    damped = np.where(y > cap, cap + INFLUENCE * (y - cap), y)
    if (y > 0).sum() >= 3:
        late = y[-recent:][y[-recent:] > 0]
        damped = np.minimum(damped, max(cap, PEAK_CEILING * np.median(late if len(late) >= 3 else y[y > 0])))
    weights = np.where(np.arange(len(y)) >= len(y) - min(recent, len(y)), RECENT_WEIGHT, 1.0)
    return float((damped * weights).sum() / weights.sum())


def uncensor(series: DataFrame, longest: int = 8) -> DataFrame:
    """Of series with y and on_hand (arrays of equal length, null without a reading): masked periods lifted to the level."""

    def lift(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            lifted, masks, levels = [], [], []
            for y, held in zip(part["y"], part["on_hand"]):
                y = np.asarray(y, float)
                mask, level = stockout_mask(y, np.array([np.nan if v is None else v for v in held], float), longest=longest)
                lifted.append(np.where(mask, np.maximum(y, level), y).tolist())
                masks.append(mask.tolist())
                levels.append(level)
            yield pd.DataFrame({"branch": part["branch"], "sku": part["sku"], "level": levels, "masked": masks, "y": lifted})

    return series.select("branch", "sku", "y", "on_hand").mapInPandas(lift, "branch string, sku string, level double, masked array<boolean>, y array<double>")


def lag_features(dense: DataFrame) -> DataFrame:
    """The training set: lags, means and spreads of the past, weeks since a sale, share of zeros, and the next value as
    target; rows without a target are dropped."""
    order = Window.partitionBy("branch", "sku").orderBy("t")
    past = lambda a, b: order.rowsBetween(-a, -b)
    zero = F.when(F.col("qty") == 0, 1).otherwise(0)
    lags = {f"lag_{k}": F.lag("qty", k).over(order) for k in (1, 2, 3, 4, 8)}
    means = {f"mean_{k}": F.bround(F.avg("qty").over(past(k, 1)), 6) for k in (4, 8, 13)}
    spreads = {f"std_{k}": F.bround(F.stddev_samp("qty").over(past(k, 1)), 6) for k in (4, 8, 13)}
    island = F.sum(F.when(F.col("qty") > 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    features = dense.withColumns(lags | means | spreads | {
        "trend_mean": F.bround(F.avg("qty").over(past(8, 5)), 6),
        # the frame counts the row before the first as well
        "zero_share_13": F.when(F.count(F.lit(1)).over(past(13, 1)) >= 4, F.bround(F.sum(zero).over(past(13, 1)) / F.least(F.col("t"), F.lit(13)), 6)),
        "__island": island, "target": F.lead("qty").over(order),
    })
    since = F.row_number().over(Window.partitionBy("branch", "sku", "__island").orderBy("t"))
    features = features.withColumn("periods_since_sale", F.when(F.col("__island") > 0, since - 1).otherwise(since))
    return features.filter("target is not null").drop("__island")
