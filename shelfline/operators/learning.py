"""Forecasts that learn: features of series, regressors of Spark ML, validation over rolling origins, fitted blends."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting, forecast, panel

#: The least history of a training row, lags, the Tweedie power, bounds of the learned ratio, the weight of
#: rows of the last periods and how many these are.
LEAST_HISTORY, LAGS, TWEEDIE_POWER, RATIO_LOW, RATIO_HIGH, RECENT_WEIGHT, RECENT_PERIODS = 4, 6, 1.3, 0.8, 1.5, 2.0, 6
FEATURES = [
    *(f"lag{k}" for k in range(1, LAGS + 1)), "roll4_mean", "roll4_max", "roll8_mean", "roll8_std", "mean_all", "std_all", "max_all", "nz_rate", "since_sale", "adi", "cv2",
    "croston", "damped", "trend", "t_idx", "month", "branch_id", "cat_id",
]


def _mean(v: Column) -> Column:
    return forecast._sum(v) / F.greatest(F.size(v), F.lit(1))


def _spread(v: Column) -> Column:
    """The population's standard deviation."""
    m = _mean(v)
    return F.sqrt(F.greatest(F.lit(0.0), _mean(F.transform(v, lambda x: x * x)) - m * m))


def features(rows: DataFrame) -> DataFrame:
    """rows: y (what a series sold up to the period that is to be told), t_idx, month, branch_id, cat_id. Adds FEATURES."""
    y, n = F.col("y"), F.size("y")
    four, eight = panel.tail(y, 4), panel.tail(y, 8)
    before = F.when(n >= 8, F.slice("y", n - 7, 4)).otherwise(F.array(F.lit(0.0)))
    sold = F.filter("y", lambda v: v > 0)
    last = F.coalesce(F.array_max(F.transform("y", lambda v, i: F.when(v > 0, i))), F.lit(-1))
    some = F.size(sold) > 0
    made = panel.damped_mean(rows, "y", "damped")
    return made.withColumns({
        **{f"lag{k}": F.coalesce(F.get("y", n - k), F.lit(0.0)) for k in range(1, LAGS + 1)},
        "roll4_mean": _mean(four), "roll4_max": F.coalesce(F.array_max(four), F.lit(0.0)), "roll8_mean": _mean(eight), "roll8_std": _spread(eight),
        "mean_all": _mean(y), "std_all": _spread(y), "max_all": F.coalesce(F.array_max("y"), F.lit(0.0)), "nz_rate": F.size(sold) / F.greatest(n, F.lit(1)),
        "since_sale": F.when(some, n - 1 - last).otherwise(n).cast("double"), "adi": F.when(some, n / F.size(sold)).otherwise(n.cast("double")),
        "cv2": F.when(some, F.pow(_spread(sold), F.lit(2.0)) / (F.pow(_mean(sold), F.lit(2.0)) + 1e-9)).otherwise(0.0),
        "croston": forecast.croston(y), "trend": _mean(four) - _mean(before),
    })


def with_ids(series: DataFrame) -> DataFrame:
    """Numbers of branches and categories, by name. There are as few as these are, so they are ranked by themselves."""
    from pyspark.sql import Window

    for name in ("branch", "category"):
        short = {"branch": "branch_id", "category": "cat_id"}[name]
        ids = series.select(name).distinct().withColumn(short, (F.row_number().over(Window.orderBy(name)) - 1).cast("double"))
        series = series.join(ids, name)
    return series


def design(series: DataFrame, first_month: int) -> DataFrame:
    """A training row for each series and period from LEAST_HISTORY on: features of what came before, target, and weight.
    series: branch, sku, category, y. first_month is the calendar month of the first period."""
    t = F.explode(F.sequence(F.lit(LEAST_HISTORY), F.size("y") - 1))
    rows = with_ids(series).withColumn("whole", F.col("y")).filter(F.size("y") > LEAST_HISTORY).select("branch", "sku", "branch_id", "cat_id", "whole", t.alias("t"))
    cut = rows.select("branch", "sku", "branch_id", "cat_id", F.slice("whole", 1, F.col("t")).alias("y"), F.col("t").cast("double").alias("t_idx"), ((F.lit(first_month - 1) + F.col("t")) % 12 + 1).cast("double").alias("month"), F.get("whole", F.col("t")).alias("target"), (F.size("whole") - F.col("t")).alias("__back"))
    weight = F.when(F.col("__back") <= RECENT_PERIODS, RECENT_WEIGHT).otherwise(1.0)
    return features(cut).withColumn("weight", weight).select("branch", "sku", *FEATURES, "target", "weight")


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def fit_trees(rows: DataFrame, rounds: int = 20, depth: int = 5, seed: int = 0):
    """Boosted trees over the training rows."""
    return GBTRegressor(labelCol="target", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed).fit(_assembled(rows))


def fit_tweedie(rows: DataFrame):
    """A generalised linear model of the Tweedie family, for counts with many zeros."""
    return GeneralizedLinearRegression(labelCol="target", weightCol="weight", family="tweedie", variancePower=TWEEDIE_POWER, linkPower=0.0, regParam=0.1, maxIter=25).fit(_assembled(rows))


def fit_ratio(rows: DataFrame, under: float = 1.6):
    """A linear model of what was sold over the base level (the larger of damped and Croston's), where that is above 0;
    rows that sold more than their base weigh `under` times as much, so that it errs upwards."""
    base = F.greatest("damped", "croston")
    known = rows.filter(base > 0).withColumn("ratio", F.greatest(F.lit(RATIO_LOW), F.least(F.lit(RATIO_HIGH), F.col("target") / base)))
    known = known.withColumn("weight", F.col("weight") * F.when(F.col("ratio") > 1, under).otherwise(1.0)).drop("target")
    return LinearRegression(labelCol="ratio", weightCol="weight", regParam=0.1).fit(_assembled(known))


def predict(model, rows: DataFrame, ratio: bool = False) -> DataFrame:
    """rows with yhat, never below 0; with ratio the model's bounded ratio of the base level."""
    if isinstance(model, boosting.Trees):
        return boosting.predict(model, rows)
    told = model.transform(_assembled(rows)).drop("features")
    value = F.greatest("damped", "croston") * F.greatest(F.lit(RATIO_LOW), F.least(F.lit(RATIO_HIGH), F.col("prediction"))) if ratio else F.col("prediction")
    return told.withColumn("yhat", F.greatest(F.lit(0.0), value)).drop("prediction")


def recursive(model, series: DataFrame, first_month: int, h: int, ratio: bool = False) -> DataFrame:
    """branch, sku, yhat (h values): each step is told from the history and the steps before it."""
    rows = with_ids(series).select("branch", "sku", "branch_id", "cat_id", "y", F.array().cast("array<double>").alias("yhats"))
    for _ in range(h):
        t = F.size("y")
        told = predict(model, features(rows.withColumns({"t_idx": t.cast("double"), "month": ((F.lit(first_month - 1) + t) % 12 + 1).cast("double")})), ratio)
        rows = told.select("branch", "sku", "branch_id", "cat_id", F.concat("y", F.array("yhat")).alias("y"), F.concat("yhats", F.array("yhat")).alias("yhats"))
    return rows.select("branch", "sku", F.col("yhats").alias("yhat"))


def rolling_origins(series: DataFrame, k: int) -> DataFrame:
    """origin, branch, sku, model, yhat, actual: each of the last k periods told by each model from what came before."""
    origins = F.explode(F.sequence(F.lit(1), F.lit(k)))
    cut = series.filter(F.size("y") > k).select("branch", "sku", origins.alias("origin"), "y")
    # one frame of shorter series, so that models run once over all origins
    shorter = cut.select(F.concat_ws("\x1f", F.col("origin").cast("string"), "branch").alias("branch"), "sku", F.slice("y", 1, F.size("y") - F.col("origin")).alias("y"), F.get("y", F.size("y") - F.col("origin")).alias("actual"))
    told = forecast.model_levels(shorter, 1).select("branch", "sku", "model", F.get("yhat", F.lit(0)).alias("yhat"))
    met = told.join(shorter.select("branch", "sku", "actual"), ["branch", "sku"])
    named = F.split("branch", "\x1f")
    return met.select(F.get(named, F.lit(0)).cast("int").alias("origin"), F.get(named, F.lit(1)).alias("branch"), "sku", "model", "yhat", "actual")


def _simplex(k: int, parts: int) -> np.ndarray:
    """All weights of k models in steps of 1 / parts."""
    cuts = np.array(list(combinations(range(parts + k - 1), k - 1)), np.int64).reshape(-1, k - 1)
    edges = np.column_stack([np.full(len(cuts), -1), cuts, np.full(len(cuts), parts + k - 1)])
    return (np.diff(edges, axis=1) - 1) / parts


def _errors(wide: DataFrame, models: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of each row of weights the sums of absolute and signed errors, and the sum of what was sold. Tasks add up their
    rows, and what comes to the driver is two numbers for each row of weights and partition."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, len(weights)))
        for part in parts:
            for at in range(0, len(part), 2000):
                some = part.iloc[at : at + 2000]
                gap = some[models].to_numpy(float) @ weights.T - some["actual"].to_numpy(float)[:, None]
                total += np.stack([np.abs(gap).sum(0), gap.sum(0)])
        yield pd.DataFrame({"i": np.arange(len(weights)), "off": total[0], "lean": total[1]})

    sums = wide.mapInPandas(add, "i int, off double, lean double").groupBy("i").agg(F.sum("off").alias("off"), F.sum("lean").alias("lean")).orderBy("i").toPandas()
    sold = wide.agg(F.sum("actual").alias("a")).first().a
    return sums["off"].to_numpy(), sums["lean"].to_numpy(), float(sold or 0) or 1.0


def loss(off: np.ndarray, lean: np.ndarray, sold: float) -> np.ndarray:
    """WAPE, with a penalty for a blend that leans less than 2 or more than 15 per cent above what was sold."""
    bias = lean / sold
    return off / sold + 14.0 * np.maximum(0.0, 0.02 - bias) ** 2 + 5.0 * np.maximum(0.0, bias - 0.15) ** 2


def fit_blend(told: DataFrame, models: list[str], parts: int = 10) -> dict[str, float]:
    """Weights of the models (at most six) of least loss over the rows of rolling_origins(): the best of all weights in
    steps of 1 / parts, then of finer steps around it. Weights of a thousandth or less fall away."""
    wide = told.groupBy("origin", "branch", "sku", "actual").pivot("model", models).agg(F.first("yhat")).na.fill(0.0).persist()
    try:
        grid, step = _simplex(len(models), parts), 1.0 / parts
        best = grid[np.argmin(loss(*_errors(wide, models, grid)))]
        for _ in range(2):
            step /= 5
            moves = np.array([best + step * j * (np.eye(len(models))[b] - np.eye(len(models))[a]) for a in range(len(models)) for b in range(len(models)) if a != b for j in range(1, 6)] + [best])
            moves = moves[(moves >= -1e-12).all(1)]
            best = moves[np.argmin(loss(*_errors(wide, models, moves)))]
    finally:
        wide.unpersist()
    return {m: round(float(w), 6) for m, w in zip(models, best) if w > 1e-3}


def in_stock_scores(cells: DataFrame, scale: float) -> DataFrame:
    """cells: model, segment, in_stock, a (sold), f (told). Errors of each model over the cells that were in stock, all
    segments together ('all') and each."""
    real = cells.filter("in_stock")
    gap = F.col("f") - F.col("a")
    both = real.withColumn("segment", F.explode(F.array("segment", F.lit("all"))))
    sums = both.groupBy("model", "segment").agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.sum(F.abs(gap)).alias("off"), F.sum(gap).alias("lean"), F.sum("a").alias("sold"))
    sold = F.when(F.col("sold") > 0, F.col("sold")).otherwise(1.0)
    return sums.select("model", "segment", F.bround("mae", 3).alias("mae"), F.bround("rmse", 3).alias("rmse"), F.bround(100 * F.col("off") / sold, 1).alias("wape"), F.bround(100 * F.col("lean") / sold, 1).alias("bias"), F.bround(F.col("mae") / F.lit(max(scale, 1e-6)), 3).alias("mase"))


DYNAMIC = ("snaive", "trees", "tweedie", "ratio", "blend")
MARGIN, CLOSE, MOST_UNDER, MOST_DEAD, MOST_UPLIFT = 5.0, 3.0, 12.0, 0.10, 2.5


def chosen(table: DataFrame, dead: DataFrame, pinned: str | None = None) -> DataFrame:
    """One row: the model to serve. table: model, wape, bias; dead: model, share of active series that it tells 0 for.
    Models that tell 0 for more than a tenth of these are out unless all are; then ones that lean under -12; of those
    within three points of the best WAPE the bias nearest to +5 in steps of five, then a model that moves, then WAPE."""
    from pyspark.sql import Window

    every = Window.partitionBy()  # a row for each model
    rows = table.join(dead, "model", "left").withColumn("__alive", F.coalesce("dead", F.lit(0.0)) <= MOST_DEAD)
    rows = rows.withColumn("__in", F.col("__alive") | ~F.max("__alive").over(every)).filter("__in")
    rows = rows.withColumn("__fair", F.col("bias") >= -MOST_UNDER).withColumn("__ok", F.col("__fair") | ~F.max("__fair").over(every)).filter("__ok")
    near = rows.withColumn("__best", F.min("wape").over(every)).filter(F.col("wape") <= F.col("__best") + CLOSE)
    ranked = near.orderBy(F.bround(F.abs(F.col("bias") - MARGIN) / 5, 0), F.when(F.col("model").isin(*DYNAMIC), 0).otherwise(1), "wape", "model").limit(1).select("model")
    if pinned is None:
        return ranked
    forced = table.filter(F.col("model") == pinned).select("model").limit(1)
    return forced.unionByName(ranked).withColumn("__order", F.when(F.col("model") == pinned, 0).otherwise(1)).orderBy("__order").limit(1).select("model")


def dead_share(levels: DataFrame, series: DataFrame, recent: int = 4) -> DataFrame:
    """model, dead: of the series that sold in the last periods, the share for which a model's first value is 0."""
    active = series.filter(F.exists(panel.tail(F.col("y"), recent), lambda v: v > 0)).select("branch", "sku")
    first = levels.join(active, ["branch", "sku"], "left_semi").select("model", F.get("yhat", F.lit(0)).alias("f"))
    return first.groupBy("model").agg(F.avg((F.col("f") == 0).cast("double")).alias("dead"))


def uplift(told: DataFrame) -> DataFrame:
    """One row: what a forecast (f) of the held-out cells (a) is raised by to lie MARGIN above what was sold, within 1 and
    MOST_UPLIFT."""
    factor = (1 + MARGIN / 100) * F.sum("a") / F.sum("f")
    return told.agg(F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(MOST_UPLIFT), factor)), F.lit(1.0)).alias("uplift"))


def category_pooled(served: DataFrame, pool: float = 0.2, members: int = 3) -> DataFrame:
    """served: branch, sku, category, yhat, level. Each forecast as a multiple of its level is drawn towards the median
    multiple of its category, where that has enough members; series without a level stay. Medians are joined by category,
    which a skewed category doesn't unbalance, as their table has a row each."""
    multiple = F.col("yhat") / F.col("level")
    typical = served.filter("level > 0").groupBy("category").agg(F.median(multiple).alias("typical"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= members)
    met = served.join(typical, "category", "left")
    drawn = ((1 - pool) * multiple + pool * F.col("typical")) * F.col("level")
    return met.withColumn("yhat", F.when((F.col("level") > 0) & F.col("typical").isNotNull(), drawn).otherwise(F.col("yhat"))).drop("typical", "n")


def forecast_state(series: DataFrame, categories: DataFrame, h: int = 3, pinned: str | None = None) -> DataFrame:
    """The served forecast: models are judged on the last h periods, the chosen one alone is fitted to all history, and its
    rate is raised by the uplift that the recent average asks for, drawn towards its category and held near its level.
    series: branch, sku, y; categories: sku, category. The model's name, a row, comes to the driver."""
    split = forecast.hold_out(series, h)
    dead = dead_share(forecast.model_levels(split, h), split)
    model = chosen(forecast.scores(series, h), dead, pinned).first().model
    level = panel.recent_level(panel.damped_mean(series, "y", "full"), "y", "recent").select("branch", "sku", "recent", "full", _mean(panel.tail(F.col("y"), 4)).alias("__recent4"))
    made = forecast.model_levels(series, h, model).select("branch", "sku", F.get("yhat", F.lit(0)).alias("__next"), _mean(F.col("yhat")).alias("yhat")).join(level, ["branch", "sku"])
    factor = uplift(made.select(F.col("__recent4").alias("a"), F.col("__next").alias("f")))
    raised = made.join(F.broadcast(factor)).withColumn("yhat", F.col("yhat") * F.col("uplift"))  # one row
    pooled = category_pooled(raised.join(categories, "sku").withColumn("level", F.col("recent")))
    done = forecast.anchored(pooled)
    return done.select("branch", "sku", F.lit(model).alias("method"), F.bround("yhat", 4).alias("monthly"), F.ceil(F.bround(F.col("yhat") / 4, 6)).alias("weekly_demand"), F.bround("recent", 4).alias("recent_level"))
