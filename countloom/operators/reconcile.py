"""Simulated counts: draws, raking to annual totals, and whole-number estimates.

Draws are an array on each month, so that their number never multiplies a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions.sums import quantile_type8


def draw_counts(df: DataFrame, *keys: str, mu: str = "pred_mean", size: str = "size", n_draws: int = 300, seed: int = 1) -> DataFrame:
    """``draws``: negative binomial counts of the given mean and size, Poisson where the
    size is infinite or null, zero where the mean isn't positive. A mean that is null or
    not finite is replaced by the mean of all finite ones; draws are null only where there
    is none. The seed of a row is a hash of its keys: the same row gives the same draws
    wherever it runs. ``df`` is read twice: write it first if it is dear."""

    @F.pandas_udf("array<bigint>")
    def sample(key: pd.Series, mean: pd.Series, dispersion: pd.Series) -> pd.Series:
        out = []
        for k, m, r in zip(key, mean, dispersion):
            if m is None or not np.isfinite(m):
                out.append(None)
                continue
            rng = np.random.default_rng(np.array([k, seed], np.int64).view(np.uint64))
            rate = np.full(n_draws, max(m, 0.0)) if r is None or not np.isfinite(r) else rng.gamma(r, max(m, 0.0) / r, n_draws)
            out.append(rng.poisson(rate))
        return pd.Series(out)

    own = F.col(mu).cast("double")
    finite = own.isNotNull() & ~F.isnan(own) & (F.abs(own) < F.lit(float("inf")))
    mean = df.agg(F.avg(F.when(finite, own)).alias("_mean"))  # one row
    out = df.crossJoin(F.broadcast(mean)).withColumn("_mu", F.when(finite, own).otherwise(F.col("_mean")))
    return out.withColumn("draws", sample(F.xxhash64(*keys), F.col("_mu"), F.col(size).cast("double"))).drop("_mean", "_mu")


def rake(df: DataFrame, *keys: str, order: str = "month", draws: str = "draws", mu: str = "pred_mean", value: str = "value", locked: str = "locked", annual: str = "annual_total", seed: int = 1, deal_zeros: bool = True) -> DataFrame:
    """``raked``: every draw made to add up to the year's total.

    Locked months keep their observation; what is left of the total is dealt to the
    others in proportion to the draw, by floors and largest remainders (ties: the earlier
    month). If nothing is left, they are zero; if a draw has only zeros there, the rest
    is dealt by a multinomial on the means, seeded by a hash of the keys, so that series
    don't share random numbers (without ``deal_zeros`` it stays at zero). Without a total draws stay as they are. Null draws
    count as zeros where there is a total, and stay null where there is none.

    A group is one key's year, some twelve rows with all draws, handled as one block.
    """
    schema = df.withColumn("raked", F.col(draws)).schema

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        own, fixed, total = list(pdf[draws]), pdf[locked].to_numpy(bool), pdf[annual].iloc[0]
        n = max((len(x) for x in own if x is not None), default=0)
        block = np.stack([np.zeros(n, np.int64) if x is None else np.asarray(x, np.int64) for x in own])
        block[fixed] = pdf.loc[fixed, value].to_numpy(np.int64)[:, None]
        free = np.flatnonzero(~fixed)
        if not pd.isna(total) and len(free):
            budget = int(total) - int(pdf.loc[fixed, value].sum())
            block[free] = _dealt(block[free], pdf[mu].to_numpy(float)[free], budget, [seed, int(pdf["_key"].iloc[0]) & (1 << 64) - 1] if deal_zeros else None)
        unknown = [x is None and not f and pd.isna(total) for x, f in zip(own, fixed)]
        pdf["raked"] = [None if lost else x for lost, x in zip(unknown, block)]
        return pdf.drop(columns="_key")

    return df.withColumn("_key", F.xxhash64(*keys)).groupBy(*keys).applyInPandas(one, schema)


#: Sums below this have products of two remainders within 63 bits.
SMALL_SUM = 3_000_000_000


def _shares(block: np.ndarray, sums: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Floors of block * budget / sums, and the remainders, in exact whole numbers."""
    whole, rest = budget // sums, budget % sums
    if sums.max() < SMALL_SUM:
        return block * whole + block * rest // sums, block * rest % sums
    product = block.astype(object) * rest  # rare: beyond 63 bits
    return block * whole + (product // sums).astype(np.int64), (product % sums).astype(np.int64)


def _dealt(block: np.ndarray, mu: np.ndarray, budget: int, seed: list[int] | None) -> np.ndarray:
    out = np.zeros_like(block)
    if budget <= 0:
        return out
    sums = block.sum(0)
    some = sums > 0
    if some.any():
        floors, rest = _shares(block[:, some], sums[some], budget)
        order = np.argsort(-rest, axis=0, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(block))[:, None], 0)
        out[:, some] = floors + (rank < budget - floors.sum(0))
    if not some.all() and seed is not None:
        weights = np.where(np.isfinite(mu) & (mu > 0), mu, 0.0)
        weights = weights / weights.sum() if weights.sum() > 0 else np.full(len(mu), 1 / len(mu))
        out[:, ~some] = np.random.default_rng(seed).multinomial(budget, weights, int((~some).sum())).T
    return out


def rake_by_windows(df: DataFrame, *keys: str, order: str = "month", draw: str = "draw", y: str = "y", value: str = "value", locked: str = "locked", annual: str = "annual_total") -> DataFrame:
    """The same on long tables of one row a month and draw, by windows only. Draws that
    are zero in all free months are left at zero: they need random numbers."""
    w = Window.partitionBy(*keys, draw)
    free = ~F.col(locked)
    own = df.withColumn("_budget", F.col(annual) - F.coalesce(F.sum(F.when(F.col(locked), F.col(value))).over(w), F.lit(0)))
    own = own.withColumn("_sum", F.sum(F.when(free, F.col(y))).over(w))
    deal = free & (F.col("_budget") > 0) & (F.col("_sum") > 0)
    own = own.withColumn("_floor", F.when(deal, F.expr(f"{y} * (_budget div _sum) + ({y} * (_budget % _sum)) div _sum")))
    own = own.withColumn("_rest", F.when(deal, F.expr(f"({y} * (_budget % _sum)) % _sum")))
    own = own.withColumn("_left", F.col("_budget") - F.sum("_floor").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc_nulls_last("_rest"), order)))
    raked = (
        F.when(F.col(locked), F.col(value)).when(F.col(annual).isNull(), F.col(y)).when(deal, F.col("_floor") + F.when(F.col("_k") <= F.col("_left"), 1).otherwise(0)).otherwise(0)
    )
    return own.withColumn("raked", raked.cast("bigint")).drop("_budget", "_sum", "_floor", "_rest", "_left", "_k")


def summarise_draws(df: DataFrame, *, draws: str = "raked", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """draw_sum, n_draws, draw_mean and the type-8 quantiles draw_lwr, draw_upr."""
    total = F.aggregate(draws, F.lit(0).cast("bigint"), lambda a, x: a + x)
    n = F.size(draws)
    return df.withColumns(
        {"draw_sum": total, "n_draws": n, "draw_mean": total / n, "draw_lwr": quantile_type8(F.col(draws), low), "draw_upr": quantile_type8(F.col(draws), high)}
    )


def whole_estimates(df: DataFrame, *keys: str, order: str = "month", value: str = "value", locked: str = "locked", annual: str = "annual_total") -> DataFrame:
    """scaled, scaled_lwr, scaled_upr: locked months as observed; others the floor of
    their mean, plus one for the largest fractions until the year's total is met (in whole
    numbers of draw_sum and n_draws; ties: the earlier month); bounds outwards."""
    w = Window.partitionBy(*keys)
    free = ~F.col(locked)
    own = df.withColumn("_budget", F.col(annual) - F.coalesce(F.sum(F.when(F.col(locked), F.col(value))).over(w), F.lit(0)))
    own = own.withColumns({"_floor": F.when(free, F.expr("draw_sum div n_draws")), "_rest": F.when(free, F.expr("draw_sum % n_draws"))})
    own = own.withColumn("_left", F.col("_budget") - F.sum("_floor").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc_nulls_last("_rest"), order)))
    scaled = (
        F.when(F.col(locked), F.col(value))
        .when(F.col("_budget") <= 0, 0)
        .when(F.col("_k") <= F.col("_left"), F.col("_floor") + 1)
        .otherwise(F.col("_floor"))
    )
    out = own.withColumns(
        {
            "scaled": scaled.cast("bigint"),
            "scaled_lwr": F.when(F.col(locked), F.col(value)).otherwise(F.floor("draw_lwr")).cast("bigint"),
            "scaled_upr": F.when(F.col(locked), F.col(value)).otherwise(F.ceil("draw_upr")).cast("bigint"),
        }
    )
    return out.drop("_budget", "_floor", "_rest", "_left", "_k")


def unreconciled(df: DataFrame, *keys: str, scaled: str = "scaled", annual: str = "annual_total") -> DataFrame:
    """Years whose months don't add up to the total: empty if all is well."""
    return df.groupBy(*keys).agg(F.sum(scaled).alias("months"), F.max(annual).alias("total")).where("total is not null and months <> total")


def assert_reconciled(df: DataFrame, *keys: str, scaled: str = "scaled", annual: str = "annual_total") -> DataFrame:
    """``df``, if the months of every year with a total add up to it; else an error."""
    wrong = unreconciled(df, *keys, scaled=scaled, annual=annual).first()
    if wrong is not None:
        raise ValueError(f"months don't add up to the total: {wrong.asDict()}")
    return df


def key_alignment(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys that repeat in a table or are missing from the other, with ``issue``."""
    out = None
    for df, name in ((left, "left"), (right, "right")):
        part = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys, F.lit(f"repeats in {name}").alias("issue"))
        out = part if out is None else out.unionByName(part)
    for a, b, name in ((left, right, "right"), (right, left, "left")):
        out = out.unionByName(a.select(*keys).distinct().join(b, list(keys), "left_anti").select(*keys, F.lit(f"missing from {name}").alias("issue")))
    return out


def publish(df: DataFrame, columns: list[str], regions: DataFrame) -> DataFrame:
    return df.select(*columns).join(regions, "series", "left")


def imputation_counts(df: DataFrame) -> DataFrame:
    """Series-years with weekly and monthly fills and with a disaggregated total."""
    years = df.groupBy("series", "year").agg(*(F.max(F.col(c)).alias(c) for c in ("imputed_weekly", "imputed_monthly", "disaggregated_yearly")))
    return years.agg(*(F.count_if(F.col(c)).alias(f"n_{c}") for c in ("imputed_weekly", "imputed_monthly", "disaggregated_yearly")))
