"""A hierarchical seasonal predictor, which gives means, bounds and dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countloom.sources.shared import saved


def seasonal_predictor(df: DataFrame, *, series: str = "series", year: str = "year", season: str = "season", region: str = "region", value: str = "value", kappa: float = 5.0) -> DataFrame:
    """Adds pred_mean, size, pred_lwr, pred_upr to every cell, observed or not.

    On the log scale, effects are taken one after the other as means of what is left,
    each shrunk by n / (n + kappa): series, (series, year), season (not shrunk),
    (region, season), (series, season). Size is by moments for each series, infinite if
    the counts spread no more than Poisson. It stands in for a fitted Bayesian model and
    doesn't give its numbers.

    Effects within a series are windows that share one shuffle on the series. Those of
    seasons have few groups: they are aggregated and joined by broadcast. The cells are
    written between the steps, so that none is computed twice.
    """
    cells = df.withColumn("_rest", F.log1p(F.col(value).cast("double")))
    cells = cells.crossJoin(F.broadcast(cells.agg(F.avg("_rest").alias("_sum")))).withColumn("_rest", F.col("_rest") - F.col("_sum"))
    cells = _within(_within(cells, kappa, series), kappa, series, year)
    for keys, k in (([season], 0.0), ([region, season], kappa)):
        cells = saved(cells, "cells")
        effects = cells.groupBy(*keys).agg((F.sum("_rest") / (F.count("_rest") + F.lit(k))).alias("_e"))
        cells = _less(cells.join(effects, keys, "left"))  # a row a season: Spark sends it to all tasks by its size
    cells = _within(cells, kappa, series, season)
    cells = cells.withColumn("pred_mean", F.greatest(F.exp("_sum") - 1, F.lit(0.0))).drop("_rest", "_sum")
    mu, y = F.col("pred_mean"), F.col(value).cast("double")
    own, seen = Window.partitionBy(series), y.isNotNull()
    spread = F.sum(F.when(seen, (y - mu) * (y - mu) - mu)).over(own)
    out = cells.withColumns({"_a": F.sum(F.when(seen, mu * mu)).over(own), "_b": spread})
    out = out.withColumn("size", F.when(F.col("_b").isNull(), None).when(F.col("_b") > 0, F.col("_a") / F.col("_b")).otherwise(F.lit(float("inf")))).drop("_a", "_b")
    half = 1.96 * F.sqrt(mu + F.coalesce(F.try_divide(mu * mu, F.col("size")), F.lit(0.0)))
    return out.withColumns({"pred_lwr": F.greatest(mu - half, F.lit(0.0)), "pred_upr": mu + half})


def _less(cells: DataFrame) -> DataFrame:
    """Moves the effect ``_e`` from what is left to the sum of effects."""
    e = F.coalesce("_e", F.lit(0.0))
    return cells.withColumns({"_rest": F.col("_rest") - e, "_sum": F.col("_sum") + e}).drop("_e")


def _within(cells: DataFrame, kappa: float, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    return _less(cells.withColumn("_e", F.try_divide(F.sum("_rest").over(w), F.count("_rest").over(w) + F.lit(kappa))))
