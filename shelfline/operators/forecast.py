"""Demand forecasts: per-series models on arrays, scoring, selection and post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import Z_ORDERS, z_score
from . import panel

#: Fixed values of the models.
CROSTON_A, DECAY, SINGLE, QUIET, BIAS_FIX, Z80 = 0.1, 0.55, 0.6, 0.35, 1.05, 1.28


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def seasonal_naive(y: Column, h: int, period: int = 4) -> Column:
    """The last `period` values again and again; the mean of a shorter series."""
    mean = _sum(y) / F.size(y)
    return F.array(*(F.when(F.size(y) >= period, F.get(y, F.size(y) - period + i % period)).otherwise(mean) for i in range(h)))


def croston(y: Column, a: float = CROSTON_A) -> Column:
    """Croston's intermittent rate with the Syntetos-Boylan correction; 0 for a series without sales."""
    start = F.struct(F.lit(None).cast("double").alias("z"), F.lit(0.0).alias("p"), F.lit(1.0).alias("q"))

    def step(s: Column, v: Column) -> Column:
        begun, sale = s["z"].isNotNull(), v > 0
        return F.struct(
            F.when(sale & begun, a * v + (1 - a) * s["z"]).when(sale, v).otherwise(s["z"]).alias("z"),
            F.when(sale & begun, a * s["q"] + (1 - a) * s["p"]).when(sale, s["q"]).otherwise(s["p"]).alias("p"),
            F.when(sale, F.lit(1.0)).otherwise(s["q"] + 1).alias("q"),
        )

    return F.aggregate(y, start, step, lambda s: F.coalesce((1 - a / 2) * s["z"] / s["p"], F.lit(0.0)))


def last_month_rule(y: Column) -> Column:
    """The last month's total and ten per cent, rounded up."""
    return F.ceil(F.bround(F.get(y, F.size(y) - 1) * 1.1, 6)).cast("double")


def ratio_base(series: DataFrame, out: str) -> DataFrame:
    """The damped mean of the last four periods, or Croston's rate if larger, unless six periods went without a sale."""
    s = panel.damped_mean(series.withColumn("__four", panel.tail(F.col("y"), 4)), "__four", "__level")
    live = F.exists(panel.tail(F.col("y"), panel.DEAD_PERIODS), lambda v: v > 0)
    return s.withColumn(out, F.when(live, F.greatest("__level", croston(F.col("y")))).otherwise(F.col("__level"))).drop("__four", "__level")


MODELS = ("snaive", "sba", "damped", "last_month", "ratio_base")


def model_levels(series: DataFrame, h: int, only: str | None = None) -> DataFrame:
    """Forecasts of all models, or of one, as rows: branch, sku, model, yhat (h values)."""
    s = series
    if only in (None, "damped"):
        s = panel.damped_mean(s, "y", "damped")
    if only in (None, "ratio_base"):
        s = ratio_base(s, "ratio_base")
    flat = lambda c: F.array_repeat(c, h)
    made = {
        "snaive": lambda: seasonal_naive(F.col("y"), h), "sba": lambda: flat(croston(F.col("y"))), "damped": lambda: flat(F.col("damped")),
        "last_month": lambda: flat(last_month_rule(F.col("y"))), "ratio_base": lambda: flat(F.col("ratio_base")),
    }
    each = F.array(*(F.struct(F.lit(m).alias("model"), made[m]().alias("yhat")) for m in MODELS if only in (None, m)))
    return s.select("branch", "sku", F.explode(each).alias("m")).select("branch", "sku", "m.model", "m.yhat")


def hold_out(series: DataFrame, h: int) -> DataFrame:
    """Splits arrays: y without its last h values, and those as actual."""
    return series.select("branch", "sku", F.slice("y", 1, F.size("y") - h).alias("y"), F.slice("y", F.size("y") - h + 1, h).alias("actual"))


def scores(series: DataFrame, h: int = 3) -> DataFrame:
    """MAE, RMSE, WAPE, bias and MASE of each model on the last h periods."""
    split = hold_out(series, h)
    moves = F.transform(F.sequence(F.lit(1), F.size("y") - 1), lambda i: F.abs(F.get(F.col("y"), i) - F.get(F.col("y"), i - 1)))
    scale = split.agg((F.sum(_sum(moves)) / F.sum(F.size("y") - 1)).alias("scale"))
    cells = model_levels(split, h).join(split.select("branch", "sku", "actual"), ["branch", "sku"]).select("model", F.explode(F.arrays_zip("actual", "yhat")).alias("c")).select("model", F.col("c.actual").alias("a"), F.col("c.yhat").alias("f"))
    sums = cells.groupBy("model").agg(F.avg(F.abs(F.col("f") - F.col("a"))).alias("mae"), F.sqrt(F.avg((F.col("f") - F.col("a")) ** 2)).alias("rmse"), (F.sum(F.abs(F.col("f") - F.col("a"))) * 100 / F.sum("a")).alias("wape"), (F.sum(F.col("f") - F.col("a")) * 100 / F.sum("a")).alias("bias"))
    return sums.join(F.broadcast(scale)).select("model", *(F.bround(c, 4).alias(c) for c in ("mae", "rmse", "wape", "bias")), F.bround(F.col("mae") / F.col("scale"), 4).alias("mase"))


def blend(levels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean over the models present, weights renormalised."""
    table = levels.sparkSession.createDataFrame(list(weights.items()), "model string, w double")
    cells = levels.join(F.broadcast(table), "model").select("branch", "sku", "w", F.posexplode("yhat").alias("h", "f"))
    return cells.groupBy("branch", "sku", "h").agg((F.sum(F.col("f") * F.col("w")) / F.sum("w")).alias("yhat"))


def anchored(served: DataFrame, down: float = 0.3, up: float = 2.0, least: float = 1.0) -> DataFrame:
    """served: branch, sku, yhat, recent, full. Rates held between bands around the recent level below and the larger of
    the recent and whole-history levels above, and at least one unit."""
    low = F.when(F.col("recent") > 0, F.greatest("yhat", F.col("recent") * max(0.0, 1 - down))).otherwise(F.col("yhat"))
    ceiling = F.greatest("recent", "full")
    held = F.when(ceiling > 0, F.least(low, ceiling * (1 + up))).otherwise(low)
    return served.withColumn("yhat", F.greatest(held, F.lit(least)))


def pattern(q: Column) -> Column:
    sold, last = F.filter(q, lambda v: v > 0), F.get(q, F.size(q) - 1)
    d1, d2 = F.get(q, F.lit(1)) - F.get(q, F.lit(0)), F.get(q, F.lit(2)) - F.get(q, F.lit(1))
    return (
        F.when(F.size(sold) == 0, "none").when((F.size(sold) == 1) & (last > 0), "new").when(last <= 0, "dropped")
        .when((F.size(q) >= 3) & (d1 > 0) & (d2 > 0), "growing").when((F.size(q) >= 3) & (d1 < 0) & (d2 < 0), "declining")
        .when(F.size(sold) < F.size(q), "intermittent").otherwise("regular")
    )


def monthly_forecast(series: DataFrame, *kept: Column | str) -> DataFrame:
    """Point forecast, spread and 80 % band of the month after the array y, with pattern and confidence; and what of the
    series is to be kept."""
    y = F.col("y")
    n, last = F.size(F.filter(y, lambda v: v > 0)), F.get(y, F.size(y) - 1)
    weight = lambda i: F.pow(F.lit(DECAY), F.size(y) - 1 - i)
    weighted = _sum(F.transform(y, lambda v, i: v * weight(i))) / _sum(F.transform(y, lambda v, i: weight(i)))
    sold = F.filter(y, lambda v: v > 0)
    raw = F.when(n == 0, 0.0).when((n == 1) & (last > 0), SINGLE * last).when(last == 0, QUIET * _sum(sold) / n).otherwise(weighted)
    spread = lambda v: F.sqrt(_sum(F.transform(v, lambda x: x * x)) / F.size(v) - F.pow(_sum(v) / F.size(v), F.lit(2.0)))
    s = series.withColumn("point", F.greatest(F.lit(0.0), raw * BIAS_FIX))
    s = s.withColumn("sigma", F.when(n == 0, 0.0).when(n >= 2, spread(y)).otherwise(0.7 * F.col("point")))
    cv = F.when(n >= 2, spread(sold) / (_sum(sold) / n))
    confidence = F.when(n <= 1, "Low").when((n == F.size(y)) & (F.coalesce(cv, F.lit(0.0)) <= 0.6), "High").otherwise("Medium")
    # products of decimal fractions lie on a half but for their last bit; a little more makes these round up
    four = lambda c, name: F.bround(c + 1e-9, 4).alias(name)
    return s.select("branch", "sku", four(F.col("point"), "point"), four(F.col("sigma"), "sigma"), four(F.greatest(F.lit(0.0), F.col("point") - Z80 * F.col("sigma")), "low"), four(F.col("point") + Z80 * F.col("sigma"), "high"), n.alias("months_sold"), pattern(y).alias("pattern"), confidence.alias("confidence"), *kept)


def backtest(series: DataFrame) -> DataFrame:
    """WAPE of the monthly forecast of the last month from those before, of two naive ones, and the skill in per cent."""
    split = hold_out(series, 1)
    made = monthly_forecast(split).join(split, ["branch", "sku"]).select(F.get("actual", F.lit(0)).alias("a"), F.col("point").alias("f"), F.get("y", F.size("y") - 1).alias("last"), (_sum(F.col("y")) / F.size("y")).alias("mean"))
    wape = lambda c: F.sum(F.abs(F.col(c) - F.col("a"))) * 100 / F.sum("a")
    sums = made.agg(F.count(F.lit(1)).alias("series"), wape("f").alias("wape"), wape("last").alias("wape_last"), wape("mean").alias("wape_mean"), (F.sum(F.col("f") - F.col("a")) * 100 / F.sum("a")).alias("bias"))
    return sums.select("series", *(F.bround(c, 2).alias(c) for c in ("wape", "wape_last", "wape_mean", "bias")), F.bround((F.col("wape_last") - F.col("wape")) / F.col("wape_last") * 100, 1).alias("skill_pct"))


def union_backtest(history: DataFrame, months: int = 6) -> DataFrame:
    """scope (a branch, or all), series, wape_pct, mae, bias_pct and the skill against the last value and the mean: the monthly
    forecast from all periods but the last, held against it. Series that only one side has count with 0 on the other;
    `series` are those with something sold or told. history: branch, sku, period, qty."""
    known = history.agg(F.array_sort(F.collect_set("period")).alias("__known"))  # one row, an entry for each period
    calendar = F.sequence(F.get("__known", F.lit(0)), F.get("__known", F.size("__known") - 2), F.expr("interval 1 month"))
    train = F.when(F.size("__known") > 1, calendar).otherwise(F.slice("__known", 1, 0))
    ends = known.select(F.get("__known", F.size("__known") - 1).alias("__end"), panel.tail(train, months).alias("__train"))
    # of a series only the last periods count, so no others are made
    at, before = F.array_position("__train", F.col("period")), F.col("period") < F.col("__end")
    cells = F.array(*(F.coalesce(F.sum(F.when(at == i + 1, F.col("qty"))), F.lit(0)).cast("double") for i in range(months)))
    series = history.filter("period is not null").join(F.broadcast(ends)).groupBy("branch", "sku").agg(
        F.slice(cells, 1, F.max(F.size("__train"))).alias("y"), F.max(before).alias("old"), F.coalesce(F.sum(F.when(F.col("period") == F.col("__end"), F.col("qty"))).cast("double"), F.lit(0.0)).alias("a")
    )
    told = monthly_forecast(series.filter("old"), "a", F.get("y", F.size("y") - 1).alias("last"), (_sum(F.col("y")) / F.size("y")).alias("mean"))
    none = F.lit(0.0)
    met = told.select("branch", F.col("point").alias("f"), "last", "mean", "a").unionByName(series.filter("not old").select("branch", none.alias("f"), none.alias("last"), none.alias("mean"), "a"))
    off = lambda c: F.sum(F.abs(F.col(c) - F.col("a")))
    sums = met.rollup("branch").agg(
        F.grouping("branch").alias("__g"), F.count_if((F.col("a") > 0) | (F.col("f") > 0)).alias("series"), F.sum("a").alias("t"), off("f").alias("e"), off("last").alias("el"), off("mean").alias("em"),
        F.bround(F.avg(F.abs(F.col("f") - F.col("a"))), 2).alias("mae"), F.sum(F.col("f") - F.col("a")).alias("over"),
    )
    pct = lambda c: F.when(F.col("t") != 0, 100 * F.col(c) / F.col("t"))
    skill = lambda c: F.when(F.col(c) != 0, F.bround(100 * (1 - F.col("wape_pct") / pct(c)), 1))
    scored = sums.withColumn("wape_pct", F.bround(pct("e"), 1))
    return scored.select(F.when(F.col("__g") == 1, "all").otherwise(F.col("branch")).alias("scope"), "series", "wape_pct", "mae", F.bround(pct("over"), 1).alias("bias_pct"), skill("el").alias("skill_vs_last_pct"), skill("em").alias("skill_vs_mean_pct"))


def order_up_to(lines: DataFrame, as_of: Column, days: int = 90, lead: int = 7, review: int = 7, z: float = 1.65, levels: DataFrame | None = None) -> DataFrame:
    """Linearly weighted daily demand (0.5 for the oldest day, 1.5 for the newest), its spread, reorder point and target.
    Days without demand count as 0 without being made: they add to neither sum. z is the quantile of the service level;
    levels (product_id, service_level) gives each product its own."""
    age = F.datediff(as_of, F.col("doc_date"))
    daily = lines.filter((age >= 0) & (age < days)).groupBy("branch_id", "product_id", age.alias("age")).agg(F.sum("requested_qty").alias("q"))
    total_weight = float(days)
    sums = daily.groupBy("branch_id", "product_id").agg((F.sum(F.col("q") * (days - 1 + 2 * (days - 1 - F.col("age")))) / (2 * (days - 1)) / total_weight).alias("daily"), F.sqrt(F.sum(F.col("q") * F.col("q")) / days - F.pow(F.sum("q") / days, F.lit(2.0))).alias("sigma"))
    quantile = F.lit(z)
    if levels is not None:
        sums, quantile = sums.join(levels.select("product_id", "service_level"), "product_id", "left"), z_score(F.col("service_level"), Z_ORDERS)
    safety = quantile * F.col("sigma") * F.sqrt(F.lit(float(lead)))
    point = F.col("daily") * lead + safety
    return sums.select("branch_id", "product_id", F.bround("daily", 6).alias("daily"), F.bround("sigma", 6).alias("sigma"), F.bround(safety, 4).alias("safety_stock"), F.bround(point, 4).alias("reorder_point"), F.bround(point + F.col("daily") * review, 4).alias("target_level"))
