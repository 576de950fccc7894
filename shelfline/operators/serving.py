"""The served forecast with every candidate on one hold-out: rules for each series, learned models and their blend."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, forecast, learning, panel

SERVED_ROUNDS = 12
Fit = Callable[[DataFrame], object]
#: Learned candidates: how each is fitted to training rows, and whether it tells a ratio of the base level.
LEARNED: dict[str, tuple[Fit, bool]] = {
    "trees": (partial(boosting.fit, features=learning.FEATURES, rounds=SERVED_ROUNDS), False),
    "tweedie": (learning.fit_tweedie, False),
    "ratio": (learning.fit_ratio, True),
}


def learned_levels(series: DataFrame, first_month: int, h: int, names: list[str]) -> DataFrame:
    """branch, sku, model, yhat of the learned candidates, each fitted to the given series alone."""
    rows = learning.design(series, first_month).persist()
    try:
        told = None
        for name in names:
            fit, ratio = LEARNED[name]
            made = learning.recursive(fit(rows), series, first_month, h, ratio).select("branch", "sku", F.lit(name).alias("model"), "yhat")
            told = made if told is None else told.unionByName(made)
        return told
    finally:
        rows.unpersist()


def blend_levels(levels: DataFrame, weights: dict[str, float]) -> DataFrame:
    cells = forecast.blend(levels, weights)
    return cells.groupBy("branch", "sku").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "yhat"))), lambda c: c.yhat).alias("yhat")).select("branch", "sku", F.lit("blend").alias("model"), "yhat")  # h values a series


def candidates(series: DataFrame, first_month: int, h: int, origins: int = 3) -> tuple[DataFrame, dict[str, float]]:
    """Levels of all candidates over the given series (branch, sku, category, y), and the blend's weights, fitted to the
    last origins of these series. Nothing after the series' end is seen."""
    rules = forecast.model_levels(series, h)
    weights = learning.fit_blend(learning.rolling_origins(series.select("branch", "sku", "y"), origins), list(forecast.MODELS))
    return rules.unionByName(blend_levels(rules, weights)).unionByName(learned_levels(series, first_month, h, list(LEARNED))), weights


def scored(levels: DataFrame, actual: DataFrame) -> DataFrame:
    """model, wape, bias over all held-out cells. actual: branch, sku, actual."""
    cells = levels.join(actual, ["branch", "sku"]).select("model", F.explode(F.arrays_zip("actual", "yhat")).alias("c")).select("model", F.col("c.actual").alias("a"), F.col("c.yhat").alias("f"))
    gap = F.col("f") - F.col("a")
    return cells.groupBy("model").agg(F.bround(100 * F.sum(F.abs(gap)) / F.sum("a"), 1).alias("wape"), F.bround(100 * F.sum(gap) / F.sum("a"), 1).alias("bias"))


def served(series: DataFrame, first_month: int, h: int = 3, pinned: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """The forecast, the candidates' scores, and the chosen model's name. series: branch, sku, category, y.

    Every candidate is fitted without the last h periods and judged on them; the chosen one alone is fitted again to all
    that is known. monthly is its mean over h periods, raised by the uplift, drawn to its category's multiple and held near
    its level, and low and high are that far from it as 80 per cent of the series' own held-out gaps reach. Series that
    are no longer than h and the least history get the level rules' candidates only, as there is nothing to learn from."""
    split = series.select("branch", "sku", "category", F.slice("y", 1, F.size("y") - h).alias("y"), F.slice("y", F.size("y") - h + 1, h).alias("actual")).filter(F.size("y") > 0)
    levels, weights = candidates(split.select("branch", "sku", "category", "y"), first_month, h)
    levels = levels.persist()
    try:
        table = scored(levels, split.select("branch", "sku", "actual"))
        dead = learning.dead_share(levels, split)
        table = table.join(dead, "model", "left").persist()
        name = learning.chosen(table.drop("dead"), table.select("model", F.coalesce("dead", F.lit(0.0)).alias("dead")), pinned).first().model
        gap = lambda c: (c.yhat - c.actual) * (c.yhat - c.actual)
        off = levels.filter(F.col("model") == name).join(split.select("branch", "sku", "actual"), ["branch", "sku"])
        spread = F.sqrt(learning._mean(F.transform(F.arrays_zip("yhat", "actual"), gap)))
        spreads = off.select("branch", "sku", spread.alias("spread"))
        scores = series.sparkSession.createDataFrame(table.collect(), table.schema)  # a row a model
        spreads = spreads.persist()
        spreads.count()
    finally:
        levels.unpersist()
    if name in LEARNED:
        final = learned_levels(series, first_month, h, [name])
    elif name == "blend":
        final = blend_levels(forecast.model_levels(series, h), weights)
    else:
        final = forecast.model_levels(series, h, name)
    known = panel.recent_level(panel.damped_mean(series, "y", "full"), "y", "recent").select("branch", "sku", "category", "recent", "full", learning._mean(panel.tail(F.col("y"), 4)).alias("__recent4"))
    made = final.select("branch", "sku", F.get("yhat", F.lit(0)).alias("__next"), learning._mean(F.col("yhat")).alias("yhat")).join(known, ["branch", "sku"])
    plain = name in ("ratio", "last_month")  # these have a margin of their own
    factor = learning.uplift(made.select(F.col("__recent4").alias("a"), F.col("__next").alias("f")))
    raised = made if plain else made.crossJoin(F.broadcast(factor)).withColumn("yhat", F.col("yhat") * F.col("uplift"))  # one row
    pooled = raised.withColumn("level", F.col("recent")) if plain else learning.category_pooled(raised.withColumn("level", F.col("recent")))
    done = (pooled if name == "last_month" else forecast.anchored(pooled)).join(spreads, ["branch", "sku"], "left")
    reach = forecast.Z80 * F.coalesce("spread", F.lit(0.0))
    rate = done.select(
        "branch", "sku", F.lit(name).alias("method"), F.bround("yhat", 4).alias("monthly"), F.round(F.bround(F.col("yhat") / 4, 6)).cast("long").alias("weekly_demand"),
        F.bround(F.greatest(F.col("yhat") - reach, F.lit(0.0)), 4).alias("low"), F.bround(F.col("yhat") + reach, 4).alias("high"),
    )
    return rate, scores, name
