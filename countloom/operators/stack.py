"""Learners combined: weights by non-negative least squares on held-out predictions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.operators.evaluate import learner_errors


def nnls(gram: np.ndarray, right: np.ndarray, *, tolerance: float = 1e-10) -> np.ndarray:
    """The w >= 0 that makes w' G w - 2 w' r least, from the sums of products alone (Lawson and
    Hanson's active sets). Learners that repeat others get no weight of their own."""
    n = len(right)
    scale = np.sqrt(np.where(np.diag(gram) > 0, np.diag(gram), 1.0))
    g, r = gram / np.outer(scale, scale), right / scale
    limit = tolerance * max(np.abs(r).max(initial=0), 1e-300)
    w, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(10 * n + 10):
        slope = np.where(free, -np.inf, r - g @ w)
        if not n or slope.max() <= limit:
            break
        free[int(slope.argmax())] = True
        while True:
            at = np.flatnonzero(free)
            trial = np.zeros(n)
            trial[at] = np.linalg.lstsq(g[np.ix_(at, at)], r[at], rcond=1e-12)[0]
            if (trial[at] > tolerance).all():
                w = trial
                break
            low = at[trial[at] <= tolerance]
            back = np.divide(w[low], w[low] - trial[low], out=np.zeros(len(low)), where=w[low] > trial[low])
            w = w + back.min() * (trial - w)
            free[free & (w <= tolerance)] = False
            w[~free] = 0
            if not free.any():
                break
    return w / scale


def _sums(learners: list[str], truth: str) -> list[Column]:
    cells = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(learners):
        cells.append(F.sum(F.col(a) * F.col(truth)).alias(f"r{i}"))
        cells.extend(F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for j, b in enumerate(learners[: i + 1]))
    return cells


def stack_weights(df: DataFrame, learners: list[str], *, truth: str = "truth", by: tuple[str, ...] = (), normalise: bool = True) -> DataFrame:
    """One row a group and learner: n, weight (adding up to one, if any is above zero and ``normalise`` is set).

    ``df`` holds predictions for rows that the learners haven't seen. Rows without truth, or that a learner
    didn't predict, are left out. One aggregate gives all sums of products, a few numbers a group, so neither
    the rows nor the groups are gathered; each group's weights are solved from its own sums. A group without rows isn't
    there; learners that predict nothing but zero have weight zero.
    """
    known = df.where(F.col(truth).isNotNull())
    for name in learners:
        known = known.where(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double")))
    known = known.select(*by, F.col(truth).cast("double").alias(truth), *(F.col(name).cast("double").alias(name) for name in learners))
    sums = (known.groupBy(*by) if by else known.groupBy(F.lit(0).alias("_all"))).agg(*_sums(learners, truth))
    keys = by or ("_all",)
    schema = ", ".join([*(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys), "n long, learner string, weight double"])

    def solve(parts):
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                gram = np.array([[row[f"g{max(i, j)}_{min(i, j)}"] for j in range(len(learners))] for i in range(len(learners))])
                w = nnls(gram, np.array([row[f"r{i}"] for i in range(len(learners))]))
                w = w / w.sum() if normalise and w.sum() > 0 else w
                out.extend((*(row[k] for k in keys), row["n"], name, float(x)) for name, x in zip(learners, w))
            yield pd.DataFrame(out, columns=[*keys, "n", "learner", "weight"])

    return sums.mapInPandas(solve, schema).select(*by, "n", "learner", "weight")


def stacked(df: DataFrame, weights: DataFrame, learners: list[str], *, by: tuple[str, ...] = (), name: str = "stack") -> DataFrame:
    """``df`` with the weighted sum of the learners; null where a learner with a weight has none,
    and in groups without weights."""
    wide = weights.groupBy(*by) if by else weights.groupBy(F.lit(0).alias("_all"))
    wide = wide.agg(*(F.max(F.when(F.col("learner") == learner, F.col("weight"))).alias(f"_w{k}") for k, learner in enumerate(learners)))
    wide = wide.select(*(F.col(key).alias(f"_by_{key}") for key in by), *(f"_w{k}" for k in range(len(learners))))
    return _combined(df, wide, learners, by, name)


def _combined(df: DataFrame, wide: DataFrame, learners: list[str], by: tuple[str, ...], name: str) -> DataFrame:
    same = F.lit(True)
    for key in by:
        same = same & F.col(key).eqNullSafe(F.col(f"_by_{key}"))
    out = df.join(wide, same, "left") if by else df.join(F.broadcast(wide), how="cross")  # one row
    total = F.lit(0.0)
    for k, learner in enumerate(learners):
        total = total + F.when(F.col(f"_w{k}") == 0, 0.0).otherwise(F.col(f"_w{k}") * F.col(learner))
    return out.withColumn(name, total).select(*df.columns, name)


def stack_by_fold(df: DataFrame, learners: list[str], *, fold: str = "fold", truth: str = "truth", name: str = "stack", normalise: bool = True) -> DataFrame:
    """Adds the stack's own held-out prediction: a fold's rows are combined with weights of all other
    folds, from sums by fold, so that the rows are read once for all of them. The number of folds is small. Weights that
    add up to one suit learners without bias; without ``normalise`` they may also stretch or shrink them."""
    known = df.where(F.col(truth).isNotNull())
    for learner in learners:
        known = known.where(F.col(learner).isNotNull() & ~F.isnan(F.col(learner).cast("double")))
    known = known.select(fold, F.col(truth).cast("double").alias(truth), *(F.col(learner).cast("double").alias(learner) for learner in learners))
    rows = known.groupBy(fold).agg(*_sums(learners, truth)).collect()  # a row a fold
    size = len(learners)
    gram = {row[fold]: np.array([[row[f"g{max(i, j)}_{min(i, j)}"] for j in range(size)] for i in range(size)]) for row in rows}
    right = {row[fold]: np.array([row[f"r{i}"] for i in range(size)]) for row in rows}
    out = []
    for own in gram:
        others = [k for k in gram if k != own]
        w = nnls(sum((gram[k] for k in others), np.zeros((size, size))), sum((right[k] for k in others), np.zeros(size)))
        if normalise:
            w = w / w.sum() if w.sum() > 0 else np.full(size, 1 / size)
        out.append((own, *map(float, w)))
    columns = [f"`_by_{fold}` {df.schema[fold].dataType.simpleString()}", *(f"_w{k} double" for k in range(size))]
    wide = df.sparkSession.createDataFrame(out, ", ".join(columns))
    return _combined(df, F.broadcast(wide), learners, (fold,), name)  # a row a fold, made here; a shuffle by fold would put all rows into as many tasks


def compare_stack(df: DataFrame, learners: list[str], *, stack: str = "stack", truth: str = "truth", by: tuple[str, ...] = ()) -> DataFrame:
    """Errors of each learner and the stack beside each other, with ``better``: by how much of the
    best single learner's error the stack's is smaller."""
    own = learner_errors(df, [stack, *learners], truth=truth, by=by)
    best = F.min(F.when(F.col("learner") != stack, F.col("rmse"))).over(Window.partitionBy(*by))  # a row a group and learner, so the rows are read once
    return own.withColumn("better", F.when(F.col("learner") == stack, F.try_divide(best - F.col("rmse"), best)))
