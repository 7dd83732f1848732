"""A fitted count model: penalised negative binomial regression with cyclic seasons."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.sources.shared import saved

#: Bounds of the linear predictor and of a step in a coefficient.
ETA, STEP = 20.0, 4.0


@dataclass(frozen=True)
class Penalties:
    """Weights of the squared effects: those of a region's and a series' level and harmonics, and of a year within a series."""

    region: float = 1.0
    region_season: float = 2.0
    series: float = 0.5
    series_season: float = 8.0
    year: float = 2.0

    def of_region(self, m: int) -> np.ndarray:
        return np.diag([self.region, *[self.region_season] * (m - 1)])

    def of_series(self, m: int) -> np.ndarray:
        return np.diag([self.series, *[self.series_season] * (m - 1)])


@dataclass(frozen=True)
class CountModel:
    """series: _key, coefficients (sum of the overall, the region's and the series' own); years: _key, _year,
    effect. ``regions`` holds each region's coefficients without a series' own, None those overall."""

    series: DataFrame
    years: DataFrame
    regions: dict[str | None, list[float]]
    theta: float
    period: int
    harmonics: int
    steps: int


def basis(season, period: int, harmonics: int) -> np.ndarray:
    """One, and cosine and sine of each harmonic of the season."""
    angle = 2 * np.pi * np.asarray(season, float)[..., None] * np.arange(1, harmonics + 1) / period
    waves = np.stack([np.cos(angle), np.sin(angle)], -1).reshape(*angle.shape[:-1], 2 * harmonics)
    return np.concatenate([np.ones((*waves.shape[:-1], 1)), waves], -1)


def basis_column(season: str, period: int, harmonics: int) -> list[Column]:
    angle = lambda k: F.col(season).cast("double") * (2 * np.pi * k / period)
    return [F.lit(1.0), *(f(angle(k)) for k in range(1, harmonics + 1) for f in (F.cos, F.sin))]


def year_effects(eta: np.ndarray, y: np.ndarray, row: np.ndarray, n: int, theta: float, penalty: float) -> np.ndarray:
    """For each of ``n`` rows the effect of its year that fits its cells best, given the rest: Newton
    steps on one number a row."""
    v = np.zeros(n)
    for _ in range(100):
        mu = np.exp(np.clip(eta + v[row], -ETA, ETA))
        slope = np.bincount(row, (y - mu) / (1 + mu / theta), n) - penalty * v
        curve = np.bincount(row, mu * (1 + y / theta) / (1 + mu / theta) ** 2, n) + penalty
        step = np.clip(slope / curve, -STEP, STEP)
        v = v + step
        if np.abs(step).max(initial=0) < 1e-12:
            break
    return v


def normal_sums(x: np.ndarray, y: np.ndarray, eta: np.ndarray, row: np.ndarray, n: int, theta: float, penalty: float) -> tuple[np.ndarray, ...]:
    """Sums of the weighted normal equations of each row's coefficients, with the effect of its year eliminated: matrices, right-hand
    sides, effects, and the two sums of the dispersion's moments."""
    v = year_effects(eta, y, row, n, theta, penalty)
    own = np.clip(eta + v[row], -ETA, ETA)
    mu = np.exp(own)
    w = mu / (1 + mu / theta)
    z = own + (y - mu) / mu
    m = x.shape[1]
    matrix, right = np.empty((n, m, m)), np.empty((n, m))
    for i in range(m):
        right[:, i] = np.bincount(row, w * z * x[:, i], n)
        for j in range(m):
            matrix[:, i, j] = np.bincount(row, w * x[:, i] * x[:, j], n)
    cross, whole, both = matrix[:, :, 0].copy(), matrix[:, 0, 0] + penalty, right[:, 0].copy()
    right -= cross * (both / whole)[:, None]
    matrix -= cross[:, :, None] * cross[:, None, :] / whole[:, None, None]
    return matrix, right, v, np.bincount(row, (y - mu) ** 2 - mu, n), np.bincount(row, mu * mu, n)


def eliminated(matrix: np.ndarray, right: np.ndarray, penalty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a group's equations say about the level above, when the group's own penalised effects, on the same basis, are solved for."""
    own = np.linalg.solve(matrix + penalty, np.concatenate([matrix, right[..., None]], -1))
    return matrix - matrix @ own[..., :-1], right - (matrix @ own[..., -1:])[..., 0]


def own_effects(matrix: np.ndarray, right: np.ndarray, penalty: np.ndarray, above: np.ndarray) -> np.ndarray:
    return np.linalg.solve(matrix + penalty, (right - (matrix @ above[..., None])[..., 0])[..., None])[..., 0]


def _lists(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float)


def fit(
    cells: DataFrame, *, series: str = "series", region: str = "region", year: str = "year", season: str = "season", value: str = "value",
    period: int = 12, harmonics: int = 2, penalties: Penalties | None = None, theta: float | None = None, tolerance: float = 1e-6, most_steps: int = 40,
) -> CountModel:
    """log mean = a curve over the season, of its own for all, each region and each series, plus a level of each
    year within a series; all but the first are penalised. Counts are negative binomial with one ``theta``, given or by
    moments. Only cells with a value count; negative ones count as zero. Without any, everything is predicted as zero.

    Each step of reweighted least squares is one pass over rows of (series, year), where the year's level is found
    and eliminated, and an aggregate by series. A series' equations are solved within its row, those of regions from one more
    aggregate, so that what reaches the driver is a small matrix a region, and no matrix grows with the number of series.
    """
    penalties = penalties or Penalties()
    spark, m = cells.sparkSession, 2 * harmonics + 1
    known = cells.where(F.col(value).isNotNull() & F.col(season).isNotNull())
    key = F.struct(F.col(region).alias("region"), F.col(series).alias("series"))
    rows = known.groupBy(key.alias("_key"), F.col(year).alias("_year")).agg(
        F.collect_list(F.struct(F.col(season).cast("double").alias("s"), F.greatest(F.col(value).cast("double"), F.lit(0.0)).alias("y"))).alias("_c")
    )  # the cells of one year
    rows = saved(rows.select("_key", "_year", F.col("_c.s").alias("_s"), F.col("_c.y").alias("_y")), "years")
    mean = rows.select(F.explode("_y").alias("y")).agg(F.avg("y")).first()[0]
    if mean is None:
        zero = [-ETA, *[0.0] * (m - 1)]
        nothing = rows.select("_key", F.array(*map(F.lit, zero)).alias("coefficients"))
        return CountModel(nothing, rows.select("_key", "_year", F.lit(0.0).alias("effect")), {None: zero}, theta or 1e6, period, harmonics, 0)
    names = [f"a{i}_{j}" for i in range(m) for j in range(i + 1)] + [f"b{i}" for i in range(m)] + ["p", "q"]
    low = np.tril_indices(m)

    def passed(columns: list, theta: float):
        lengths = np.diff(columns[0].offsets.to_numpy())
        row, n = np.repeat(np.arange(len(lengths)), lengths), len(lengths)
        x, y = basis(_lists(columns[0]), period, harmonics), _lists(columns[1])
        c = _lists(columns[2]).reshape(n, m)
        return normal_sums(x, y, (x * c[row]).sum(1), row, n, theta, penalties.year)

    def unfolded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([batch.column(name).to_numpy() for name in names], 1)
        matrix = np.zeros((len(sums), m, m))
        matrix[:, low[0], low[1]] = matrix[:, low[1], low[0]] = sums[:, : len(low[0])]
        return matrix, sums[:, len(low[0]) : len(low[0]) + m]

    def yearly(theta: float):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    matrix, right, _, p, q = passed([batch.column(k) for k in (1, 2, 3)], theta)
                    arrays = [*matrix[:, low[0], low[1]].T, *right.T, p, q]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), *(pa.array(np.ascontiguousarray(a)) for a in arrays)], ["_key", "_old", *names])

        return run

    def regional(batches):
        for batch in batches:
            if batch.num_rows:
                matrix, right = eliminated(*unfolded(batch), penalties.of_series(m))
                arrays = [*matrix[:, low[0], low[1]].T, *right.T, batch.column("p").to_numpy(), batch.column("q").to_numpy()]
                yield pa.RecordBatch.from_arrays([batch.column("region"), *(pa.array(np.ascontiguousarray(a)) for a in arrays)], ["region", *names])

    def updated(above: dict[str | None, np.ndarray]):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    base = np.stack([above[r] for r in batch.column("region").to_pylist()])
                    new = base + own_effects(*unfolded(batch), penalties.of_series(m), base)
                    old = _lists(batch.column("_old")).reshape(-1, m)
                    change = new - old
                    most = np.abs(change).max(1)
                    new = old + change * np.minimum(1, STEP / np.maximum(most, 1e-300))[:, None]
                    yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(list(new), pa.list_(pa.float64())), pa.array(most)], ["_key", "coefficients", "change"])

        return run

    key_type, sums = rows.schema["_key"].dataType.simpleString(), ", ".join(f"{name} double" for name in names)
    region_type = rows.schema["_key"].dataType["region"].dataType.simpleString()
    start = [float(np.log(mean + 0.1)), *[0.0] * (m - 1)]
    coefficients = rows.select("_key").distinct().withColumn("coefficients", F.array(*map(F.lit, start)))
    size, steps, above = theta or 1.0, 0, {}
    for steps in range(1, most_steps + 1):
        own = rows.join(coefficients.select("_key", F.col("coefficients").alias("_old")), "_key").select("_key", "_s", "_y", "_old")
        made = own.mapInArrow(yearly(size), f"_key {key_type}, _old array<double>, {sums}")
        made = saved(made.groupBy("_key", "_old").agg(*(F.sum(name).alias(name) for name in names)).withColumn("region", F.col("_key.region")), "equations")
        by_region = made.mapInArrow(regional, f"region {region_type}, {sums}").groupBy("region").agg(*(F.sum(name).alias(name) for name in names)).collect()
        above, moments = _regions_solved(by_region, names, m, penalties.of_region(m))
        coefficients = saved(made.mapInArrow(updated(above), f"_key {key_type}, coefficients array<double>, change double"), "coefficients")
        change = coefficients.agg(F.max("change")).first()[0]
        before = size
        if theta is None:
            size = float(np.clip(moments[1] / moments[0], 1e-3, 1e6)) if moments[0] > 0 else 1e6
        if change < tolerance and abs(size / before - 1) < 1e-6:
            break

    def effects(batches):
        for batch in batches:
            if batch.num_rows:
                v = passed([batch.column(k) for k in (2, 3, 4)], size)[2]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(v)], ["_key", "_year", "effect"])

    own = rows.join(coefficients.select("_key", "coefficients"), "_key").select("_key", "_year", "_s", "_y", "coefficients")
    years = saved(own.mapInArrow(effects, f"_key {key_type}, _year {rows.schema['_year'].dataType.simpleString()}, effect double"), "effects")
    return CountModel(coefficients.select("_key", "coefficients"), years, {name: list(map(float, c)) for name, c in above.items()}, size, period, harmonics, steps)


def _regions_solved(rows: list, names: list[str], m: int, penalty: np.ndarray) -> tuple[dict, np.ndarray]:
    """Coefficients of each region, and under None those overall; and the sums of the moments."""
    low = np.tril_indices(m)
    sums = np.array([[row[name] for name in names] for row in rows], float)
    matrix = np.zeros((len(rows), m, m))
    matrix[:, low[0], low[1]] = matrix[:, low[1], low[0]] = sums[:, : len(low[0])]
    right = sums[:, len(low[0]) : len(low[0]) + m]
    reduced, rest = eliminated(matrix, right, penalty)
    overall = np.linalg.solve(reduced.sum(0) + 1e-9 * np.eye(m), rest.sum(0))
    out = {row["region"]: overall + own_effects(matrix[k], right[k], penalty, overall) for k, row in enumerate(rows)}
    out.setdefault(None, overall)
    return out, sums[:, -2:].sum(0)


def predict(model: CountModel, df: DataFrame, *, series: str = "series", region: str = "region", year: str = "year", season: str = "season") -> DataFrame:
    """Adds pred_mean, size, pred_lwr, pred_upr to every row. A year that the fit hasn't seen has no level of its own;
    a series that it hasn't seen has its region's curve, in an unseen region that of all."""
    spark = df.sparkSession
    known = [(name, c) for name, c in model.regions.items() if name is not None]
    regions = spark.createDataFrame(known, f"_region {df.schema[region].dataType.simpleString()}, _above array<double>")
    overall = F.array(*map(F.lit, model.regions[None]))
    key = F.struct(F.col(region).alias("region"), F.col(series).alias("series"))
    own = df.withColumns({"_key": key, "_year": F.col(year)}).join(model.series, "_key", "left").join(model.years, ["_key", "_year"], "left")
    own = own.join(regions, F.col(region) == F.col("_region"), "left").withColumn("_c", F.coalesce("coefficients", "_above", overall))
    eta = F.coalesce("effect", F.lit(0.0))
    for k, b in enumerate(basis_column(season, model.period, model.harmonics)):
        eta = eta + F.col("_c")[k] * b
    mean = F.when(eta.isNotNull(), F.exp(F.greatest(F.least(eta, F.lit(ETA)), F.lit(-ETA))))  # null without a season
    own = own.withColumns({"pred_mean": mean, "size": F.lit(model.theta)}).select(*df.columns, "pred_mean", "size")
    half = 1.96 * F.sqrt(F.col("pred_mean") + F.col("pred_mean") * F.col("pred_mean") / F.col("size"))
    return own.withColumns({"pred_lwr": F.greatest(F.col("pred_mean") - half, F.lit(0.0)), "pred_upr": F.col("pred_mean") + half})


def count_predictor(df: DataFrame, **kwargs) -> DataFrame:
    """Fits the cells with a value and predicts all: takes the place of ``predict.seasonal_predictor`` in the jobs."""
    names = {name: kwargs[name] for name in ("series", "region", "year", "season") if name in kwargs}
    df = saved(df, "cells")
    return predict(fit(df, **kwargs), df, **names)
