"""The count model against a dense solve, on odd tables, and beside the other predictor."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import count_model, predict

SCHEMA = "series string, region string, year int, season int, value long"


def simulated(seed, n_series=6, years=4, theta=4.0, gaps=0.15):
    rng, rows, truth = np.random.default_rng(seed), [], {}
    for s in range(n_series):
        level, phase = rng.normal(2.5, 0.7), rng.normal(0, 0.3) + (s % 2)
        for y in range(years):
            year = rng.normal(0, 0.5)
            for k in range(1, 13):
                mu = math.exp(level + year + 0.8 * math.cos(2 * math.pi * k / 12 - phase))
                truth[f"s{s}", 2000 + y, k] = mu
                value = None if rng.random() < gaps else int(rng.negative_binomial(theta, theta / (theta + mu)))
                rows.append((f"s{s}", f"r{s % 2}", 2000 + y, k, value))
    return rows, truth


def dense(rows, theta, p, harmonics=2):
    """All effects in one design, solved at once until nothing changes."""
    rows = [r for r in rows if r[4] is not None]
    m = 2 * harmonics + 1
    b = count_model.basis([r[3] for r in rows], 12, harmonics)
    y = np.array([r[4] for r in rows], float)
    regions, series, years = (sorted(set(x)) for x in zip(*((r[1], r[0], (r[0], r[2])) for r in rows)))
    blocks, penalty = [b], [1e-9] * m
    for r in regions:
        blocks.append(b * np.array([x[1] == r for x in rows])[:, None])
        penalty += [p.region] + [p.region_season] * (m - 1)
    for s in series:
        blocks.append(b * np.array([x[0] == s for x in rows])[:, None])
        penalty += [p.series] + [p.series_season] * (m - 1)
    for own in years:
        blocks.append(np.array([(x[0], x[2]) == own for x in rows], float)[:, None])
        penalty += [p.year]
    x, penalty = np.concatenate(blocks, 1), np.diag(penalty)
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(y.mean() + 0.1)
    for _ in range(200):
        mu = np.exp(x @ beta)
        w, z = mu / (1 + mu / theta), x @ beta + (y - mu) / mu
        new = np.linalg.solve(x.T @ (w[:, None] * x) + penalty, x.T @ (w * z))
        done = np.abs(new - beta).max() < 1e-12
        beta = new
        if done:
            break
    at = m + m * len(regions)
    above = {r: beta[:m] + beta[m + m * k : 2 * m + m * k] for k, r in enumerate(regions)}
    region_of = {r[0]: r[1] for r in rows}
    own = {s: above[region_of[s]] + beta[at + m * k : at + m * (k + 1)] for k, s in enumerate(series)}
    return beta[:m], above, own, dict(zip(years, beta[at + m * len(series) :]))


@pytest.mark.parametrize("seed, harmonics", [(1, 2), (2, 1)])
def test_coefficients_equal_a_dense_solve(spark, seed, harmonics):
    rows, _ = simulated(seed)
    p = count_model.Penalties(region=0.7, region_season=1.5, series=0.4, series_season=3.0, year=1.2)
    model = count_model.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), penalties=p, theta=4.0, harmonics=harmonics, tolerance=1e-9)
    overall, above, own, years = dense(rows, 4.0, p, harmonics)
    assert model.steps < 40
    assert np.allclose(model.regions["r0"], above["r0"], atol=1e-6) and np.allclose(model.regions["r1"], above["r1"], atol=1e-6) and np.allclose(model.regions[None], overall, atol=1e-6)
    assert {r._key.series: r.coefficients for r in model.series.collect()}.keys() == own.keys()
    for r in model.series.collect():
        assert np.allclose(r.coefficients, own[r._key.series], atol=1e-6)
    for r in model.years.collect():
        assert abs(r.effect - years[r._key.series, r._year]) < 1e-6


def test_gaps_are_predicted_better_than_by_means(spark):
    """Means of cells that nobody saw, of the model and of the chain of shrunken means."""
    rows, truth = simulated(5, n_series=12, years=6, theta=8.0, gaps=0.3)
    df = spark.createDataFrame(rows, SCHEMA)
    scores = []
    for made in (count_model.count_predictor(df), predict.seasonal_predictor(df)):
        hidden = made.where("value is null").collect()
        scores.append(np.mean([abs(math.log(r.pred_mean + 0.5) - math.log(truth[r.series, r.year, r.season] + 0.5)) for r in hidden]))
    assert scores[0] < scores[1]
    model = count_model.fit(df)
    assert 5 < model.theta < 14
    inside = count_model.predict(model, df).where("value is not null").agg(F.avg((F.col("value").between(F.col("pred_lwr"), F.col("pred_upr"))).cast("double"))).first()[0]
    assert 0.9 < inside < 1


def test_odd_tables(spark):
    """Series of zeros, one cell, nulls in keys, unseen series, regions and years, and no cell at all."""
    rows = [("zero", "r", 2000, k, 0) for k in range(1, 13)] + [("one", "r", 2000, 3, 7), (None, None, 2000, 5, 4), ("s", "q", None, 6, 9), ("s", "q", 2001, None, 9), ("neg", "r", 2000, 1, -5)]
    df = spark.createDataFrame(rows + [("new", "r", 2003, 4, None), ("new", "elsewhere", 2003, 4, None)], SCHEMA)
    got = {(r.series, r.region, r.year, r.season): r.pred_mean for r in count_model.count_predictor(df).collect()}
    assert len(got) == len(rows) + 2 and all(v is None or (math.isfinite(v) and v >= 0) for v in got.values())
    assert got["zero", "r", 2000, 3] < 0.5 < got["one", "r", 2000, 3] and [k for k, v in got.items() if v is None] == [("s", "q", 2001, None)]
    empty = count_model.count_predictor(df.where("value is null"))
    assert empty.count() == 2 and empty.where("pred_mean > 1e-6").isEmpty()
    assert count_model.count_predictor(df.limit(0)).isEmpty()
