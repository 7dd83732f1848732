"""Weights of learners against all subsets, and the stack's own held-out error."""

from itertools import chain, combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from countloom.operators import stack
from countloom.plans import queries_series


def by_subsets(gram, right):
    """The best of the least-squares solutions of all subsets that have no negative weight."""
    n, best = len(right), (0.0, np.zeros(len(right)))
    for own in chain.from_iterable(combinations(range(n), k) for k in range(1, n + 1)):
        own = list(own)
        if np.linalg.matrix_rank(gram[np.ix_(own, own)]) < len(own):
            continue
        w = np.zeros(n)
        w[own] = np.linalg.solve(gram[np.ix_(own, own)], right[own])
        if (w >= -1e-12).all():
            best = min(best, (float(w @ gram @ w - 2 * w @ right), w), key=lambda x: x[0])
    return best


@pytest.mark.parametrize("n, m", [(1, 5), (2, 30), (4, 30), (6, 8), (5, 3)])
def test_weights_are_the_best_of_all_subsets(n, m):
    rng = np.random.default_rng(n * m)
    for _ in range(60):
        x = rng.normal(size=(m, n)) * rng.choice([0.01, 1, 50], n)
        if n > 2 and rng.random() < 0.4:
            x[:, 1] = x[:, 0]
        if rng.random() < 0.2:
            x[:, -1] = 0
        y = x @ np.maximum(rng.normal(size=n), 0) + rng.normal(size=m)
        gram, right = x.T @ x, x.T @ y
        w = stack.nnls(gram, right)
        assert (w >= 0).all() and w @ gram @ w - 2 * w @ right <= by_subsets(gram, right)[0] + 1e-7 * (1 + y @ y)


def made(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(600):
        t = float(rng.gamma(2, 20))
        group = ["a", "b", None][k % 3]
        rows.append((group, k % 4, t, t + rng.normal(0, 6), 0.5 * t + rng.normal(0, 2), float(rng.normal(30, 10)), None if k % 50 == 0 else t * 1.1 + rng.normal(0, 9)))
    rows.append(("none", 0, 5.0, None, 1.0, 1.0, 1.0))
    rows.append(("zero", 1, 5.0, 0.0, 0.0, 0.0, 0.0))
    return rows, spark.createDataFrame(rows, "grp string, fold int, truth double, p double, q double, r double, s double").repartition(4)


def test_groups(spark):
    """Each group by itself, a null group too; rows that a learner lacks are left out; one of zeros only has no weights."""
    rows, df = made(spark)
    names = ["p", "q", "r", "s"]
    got = {(r.grp, r.learner): (r.n, r.weight) for r in stack.stack_weights(df, names, by=("grp",)).collect()}
    assert {g for g, _ in got} == {"a", "b", None, "zero"} and all(got["zero", x] == (1, 0.0) for x in names)
    for group in ("a", "b", None):
        own = np.array([r[2:] for r in rows if r[0] == group and None not in r[2:]], float)
        w = by_subsets(own[:, 1:].T @ own[:, 1:], own[:, 1:].T @ own[:, 0])[1]
        assert np.allclose([got[group, x][1] for x in names], w / w.sum(), atol=1e-8) and got[group, "p"][0] == len(own)
    whole = {r.learner: r.weight for r in stack.stack_weights(df, names).collect()}
    assert sum(whole.values()) == pytest.approx(1) and whole["r"] < 0.05
    out = stack.stacked(df, stack.stack_weights(df, names, by=("grp",)), names, by=("grp",)).where("grp = 'a' and s is not null")
    r = out.first()
    assert r.stack == pytest.approx(sum(r[x] * got["a", x][1] for x in names)) and stack.stack_weights(df.limit(0), names).isEmpty()


def test_stack_is_scored_on_rows_that_its_weights_have_not_seen(spark):
    rows, df = made(spark)
    names = ["p", "q", "r"]
    df = df.where("grp is not null and grp <> 'zero' and p is not null")
    for normalise in (True, False):
        own = stack.stack_by_fold(df, names, normalise=normalise)
        for fold in range(4):
            other = np.array([r[2:6] for r in rows if r[1] != fold and r[0] in ("a", "b")], float)
            w = stack.nnls(other[:, 1:].T @ other[:, 1:], other[:, 1:].T @ other[:, 0])
            for r in own.where(F.col("fold") == fold).limit(5).collect():
                assert r.stack == pytest.approx(float(np.dot([r.p, r.q, r.r], w / w.sum() if normalise else w)))
    errors = {r.learner: r for r in stack.compare_stack(own, names).collect()}  # q is half the truth
    assert errors["stack"].rmse < min(errors[x].rmse for x in names) and 0 < errors["stack"].better < 1 and errors["p"].better is None


def test_rows_are_not_shuffled_for_the_stack(spark, sf_dir):
    """Neither for the weights of their fold nor for the means of other years, and scores read them once."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    _, df = made(spark)
    own = stack.stack_by_fold(df.where("grp in ('a', 'b')"), ["p", "q", "r"])
    assert "Exchange hashpartitioning" not in plan(own) and "SortMergeJoin" not in plan(own)
    assert plan(stack.compare_stack(own, ["p", "q", "r"])).count("Expand") == 1
    learned = queries_series._learners(spark, sf_dir)
    assert "Exchange hashpartitioning" not in plan(learned) and learned.count() > 0


def test_folds_and_groups_that_are_null(spark):
    """A null fold has the other folds' weights, a null group its own best learner."""
    rows, _ = made(spark)
    df = spark.createDataFrame([(r[0], r[1] or None, *r[2:5]) for r in rows if r[0] not in ("none", "zero")], "grp string, fold int, truth double, p double, q double").where("p is not null")
    own = stack.stack_by_fold(df, ["p", "q"])
    assert own.where("fold is null").count() == 150 and own.where("stack is null").isEmpty() and own.count() == df.count()
    better = {r.grp: r for r in stack.compare_stack(own, ["p", "q"], by=("grp",)).collect() if r.learner == "stack"}
    best = {r.grp: r.rmse for r in stack.compare_stack(own, ["p", "q"], by=("grp",)).orderBy(F.desc("rmse")).collect() if r.learner != "stack"}
    assert set(better) == {"a", "b", None} and all(r.better == pytest.approx((best[g] - r.rmse) / best[g]) for g, r in better.items())
