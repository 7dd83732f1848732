"""Scores of predictions by model, mask and fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions.numbering import running_before

FOLD = ("model", "mask_type", "fold")


def apply_mask(df: DataFrame, mask: DataFrame, fold: int, *, row_id: str = "row_id", value: str = "value") -> DataFrame:
    """Marks the rows of a fold as test rows and hides their outcome."""
    own = df.join(mask.select(row_id, F.col("fold").alias("_fold")), row_id, "left")
    test = F.coalesce(F.col("_fold") == fold, F.lit(False))
    return own.withColumns({"is_test": test, "truth": F.col(value), value: F.when(~test, F.col(value))}).drop("_fold")


def point_metrics(results: DataFrame, *by: str, truth: str = "truth", pred: str = "pred", pop: str = "pop", per: float = 1e5, pop_floor: float = 1.0) -> DataFrame:
    """n, MAE and RMSE of counts and of incidence (negative predictions count as zero
    there); rows without truth or population are left out."""
    own = results.where(F.col(truth).isNotNull() & F.col(pred).isNotNull() & F.col(pop).isNotNull())
    scale = F.lit(per) / F.greatest(F.col(pop).cast("double"), F.lit(pop_floor))
    e = F.col(pred) - F.col(truth)
    i = (F.greatest(F.col(pred), F.lit(0.0)) - F.col(truth)) * scale
    return own.groupBy(*(by or FOLD)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(i)).alias("mae_inc"), F.sqrt(F.avg(i * i)).alias("rmse_inc")
    )


def interval_score(y: Column, low: Column, high: Column) -> Column:
    return (high - low) + 10 * F.greatest(low - y, F.lit(0.0)) + 10 * F.greatest(y - high, F.lit(0.0))


def wis80(y: Column, median: Column, low: Column, high: Column, *, form: str = "weighted") -> Column:
    """Weighted interval score of an 80 % interval, in either of its two forms."""
    off, score = F.abs(y - median), interval_score(y, low, high)
    return (0.5 * off + 0.1 * score) / 0.6 if form == "weighted" else (off + score) / 1.5


def interval_metrics(results: DataFrame, *by: str, truth: str = "truth", form: str = "weighted") -> DataFrame:
    y, m, low, high = F.col(truth), F.col("q50"), F.col("q10"), F.col("q90")
    own = results.where(y.isNotNull() & m.isNotNull())
    return own.groupBy(*(by or FOLD)).agg(F.count(F.lit(1)).alias("n"), F.avg(((y >= low) & (y <= high)).cast("double")).alias("cov80"), F.avg(wis80(y, m, low, high, form=form)).alias("wis80"))


def weighted_overall(folds: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """Means of fold metrics weighted by n; a fold without a metric has no weight in it."""
    by = by or ("model", "mask_type")
    mean = lambda m: F.try_divide(F.sum(F.when(F.col(m).isNotNull(), F.col("n") * F.col(m))), F.sum(F.when(F.col(m).isNotNull(), F.col("n"))).cast("double"))
    return folds.groupBy(*by).agg(F.sum("n").alias("n"), *(mean(m).alias(m) for m in metrics))


def row_count_check(results: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows of result and mask by mask type, with the difference."""
    a = results.groupBy("mask_type").agg(F.count(F.lit(1)).alias("n_result"))
    b = mask.groupBy("mask_type").agg(F.count(F.lit(1)).alias("n_mask"))
    return a.join(b, "mask_type", "full").withColumn("diff", F.coalesce("n_result", F.lit(0)) - F.coalesce("n_mask", F.lit(0)))


def reused_points(results: DataFrame, *key: str) -> DataFrame:
    key = key or ("model", "mask_type", "row_id")
    return results.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def learner_errors(df: DataFrame, learners: list[str], *, truth: str = "truth", by: tuple[str, ...] = ()) -> DataFrame:
    """RMSE of each learner's column with standard error and 95 % bounds."""
    own = df.unpivot([*by, truth], learners, "learner", "pred").where(F.col("pred").isNotNull() & F.col(truth).isNotNull())
    e = F.col("pred") - F.col(truth)
    out = own.groupBy(*by, "learner").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.stddev_samp(F.abs(e)) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return out.withColumns({"lower": F.col("rmse") - 1.96 * F.col("se"), "upper": F.col("rmse") + 1.96 * F.col("se")})


def error_by_series(df: DataFrame, *, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """MAE of each series, and a row GLOBAL for all."""
    e = F.abs(F.col(pred) - F.col(truth))
    out = df.where(e.isNotNull()).rollup("series").agg(F.avg(e).alias("mae"), F.count(F.lit(1)).alias("n"), F.grouping("series").alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "GLOBAL").otherwise(F.col("series")).alias("series"), "mae", "n")


def fold_descriptors(df: DataFrame) -> DataFrame:
    return df.groupBy("fold").agg(
        F.countDistinct("series").alias("n_series"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min("start_date").alias("first_date"), F.max("start_date").alias("last_date"), F.sum("truth").alias("total"),
    )


def draw_quantiles(df: DataFrame, *, draws: str = "draws", pop: str = "pop", per: float = 1e5) -> DataFrame:
    """q10, q50, q90 of an array of draws as incidence (type 7: linear at (n - 1) p)."""
    own = F.array_sort(draws)
    n = F.size(draws)
    out = {}
    for name, p in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9)):
        h = (n - 1) * F.lit(p) + 1
        low = F.floor(h + 1e-9).cast("int")
        a, b = F.try_element_at(own, low).cast("double"), F.try_element_at(own, F.least(low + 1, n)).cast("double")
        out[name] = F.when(n > 0, (a + (h - low) * (b - a)) * F.lit(per) / F.col(pop))
    return df.withColumns(out)


def fallback_bounds(mu: Column, theta: Column, scale: Column) -> tuple[Column, Column]:
    """Mean plus and minus 1.28 standard deviations of the counts; Poisson without theta."""
    sd = F.sqrt(mu + F.coalesce(F.try_divide(mu * mu, theta), F.lit(0.0)))
    return F.greatest((mu - 1.28 * sd) / scale, F.lit(0.0)), (mu + 1.28 * sd) / scale


def with_row_id(df: DataFrame, *, series: str = "series", order: str = "time_seq") -> DataFrame:
    """Position after sorting by series and time: the number within the series plus an
    offset from a running sum over one row a series, so the fact isn't sorted as a whole."""
    counts = df.groupBy(series).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_before(counts, series, "_n", "_before").select(series, "_before")
    own = df.withColumn("_k", F.row_number().over(Window.partitionBy(series).orderBy(order)))
    return own.join(offsets, series).withColumn("row_id", F.col("_k") + F.col("_before")).drop("_k", "_before")
