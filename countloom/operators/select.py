"""The best record of each series and year, and scaling to annual totals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.functions.calendar import weeks_in_year

# Series whose sub-annual reports are always preferred.
SPECIAL = ("HONG KONG", "JAPAN", "TAIWAN")
CASES = ("Case 1: Annual only", "Case 2: Sub-annual only", "Case 3: Both")
_LEVELS = ("a0", "a1", "a2")


def _candidates(levels: DataFrame, special: tuple[str, ...]) -> DataFrame:
    """Level counts with largest count and sum, chosen level, and completeness."""
    n = F.greatest(*(F.col(f"{k}_count") for k in _LEVELS))
    total = F.greatest(*(F.col(f"{k}_sum") for k in _LEVELS))
    level, own_n = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for k in reversed(_LEVELS):  # the first level with the largest sum
        level = F.when(F.col(f"{k}_sum") == total, k).otherwise(level)
        own_n = F.when(F.col(f"{k}_sum") == total, F.col(f"{k}_count")).otherwise(own_n)
    by_count = F.lit(None).cast("string")  # of the levels with the largest count, the one with the largest sum
    most = F.greatest(*(F.when(F.col(f"{k}_count") == n, F.coalesce(F.col(f"{k}_sum"), F.lit(-1))) for k in _LEVELS))
    for k in reversed(_LEVELS):
        by_count = F.when((F.col(f"{k}_count") == n) & (F.coalesce(F.col(f"{k}_sum"), F.lit(-1)) == most), k).otherwise(by_count)
    out = levels.withColumns({"max_count": n, "max_sum": total, "level": level, "level_by_count": by_count, "level_count": own_n, "expected": weeks_in_year("year"), "special": F.col("series").isin(*special)})
    complete = F.when(F.col("t_res") == "Week", F.col("level_count") >= F.col("expected")).when(F.col("t_res") == "Month", F.col("level_count") == 12).otherwise(False)
    return out.withColumns({"complete": F.coalesce(complete, F.lit(False)), "annual": F.col("t_res") == "Year", "proportion": F.col("max_count") / F.col("expected")})


def judged(levels: DataFrame, *, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """One row a series and year: the best annual record y and the best sub-annual one s (of
    ``rollup.level_counts``), the chosen one c, and what the choice went by: category,
    case, pct_of_annual, annual_total, done (s is complete and counts), two (there are both).

    A single pass: the best of either kind is found by ordering, and a chain of
    conditions chooses between them.
    """
    rows = _candidates(levels, special)
    order = (
        F.when(F.col("special"), F.col("max_count").cast("double")).otherwise(F.col("max_sum").cast("double")),
        F.when(F.col("special"), F.col("max_sum").cast("double")).otherwise(F.col("proportion")),
        F.col("proportion"),
    )
    w = Window.partitionBy("series", "year", "annual").orderBy(*(F.desc_nulls_last(o) for o in order), "t_res")
    fields = F.struct("t_res", "level", "level_by_count", "level_count", "max_count", "max_sum", "complete")
    ranked = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").withColumn("rec", fields)
    both = ranked.groupBy("series", "year").agg(
        F.max(F.when(F.col("annual"), F.col("rec"))).alias("y"), F.max(F.when(~F.col("annual"), F.col("rec"))).alias("s"), F.first("special").alias("special")
    )
    y, s = F.col("y.max_sum"), F.col("s.max_sum")
    two = F.col("y").isNotNull() & F.col("s").isNotNull()
    zero = ~F.col("special") & (s == 0) & (y != 0)
    done = F.col("s.complete") & ~F.coalesce(zero, F.lit(False))
    pct = F.when(two & (y > 0), 100.0 * s / y)
    annual_larger = F.coalesce(y > s, F.lit(False))
    take_annual = F.col("s").isNull() | (two & annual_larger & (~done | ~F.col("special")))
    category = (
        F.when(two & ~done & annual_larger & F.col("s.complete"), "Sub-annual sum zero - annual selected")
        .when(two & ~done & annual_larger, "Incomplete sub-annual - annual selected")
        .when(two & ~done, "Incomplete sub-annual - sub-annual selected")
        .when(two & annual_larger & ~F.col("special"), "Annual > sub-annual")
        .when(two & F.col("special"), "Special country - sub-annual selected")
        .when(two, "Sub-annual >= Annual")
        .when(F.col("y").isNull(), CASES[1])
        .otherwise(CASES[0])
    )
    total = (
        F.when(~two, F.coalesce(y, s))
        .when(take_annual, y)
        .when(~done, s)
        .when(pct.isNull(), F.lit(None).cast("bigint"))
        .when((pct >= 80) & (pct < 100), y)
        .otherwise(s)
    )
    chosen = F.when(take_annual, F.col("y")).otherwise(F.col("s"))
    case = F.when(two, CASES[2]).when(F.col("y").isNull(), CASES[1]).otherwise(CASES[0])
    level = F.when(F.col("special") & F.col("y").isNull(), F.col("c.level_by_count")).otherwise(F.col("c.level"))
    return both.withColumns({"c": chosen, "case": case, "chosen_level": level, "category": category, "pct_of_annual": pct, "annual_total": total, "done": done, "two": two})


def best_records(levels: DataFrame, *, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """One row a series and year: t_res, level, final_count, final_sum, category,
    pct_of_annual, annual_total, complete, and case (which of annual and sub-annual
    records there were), from ``rollup.level_counts``."""
    return judged(levels, special=special).select(
        "series", "year", "c.t_res", F.col("chosen_level").alias("level"), F.col("c.level_count").alias("final_count"), F.col("c.max_sum").alias("final_sum"), "category", "pct_of_annual", "annual_total",
        F.when(F.col("s").isNotNull(), F.when(F.col("two"), F.col("done")).otherwise(F.col("s.complete"))).alias("complete"), "case",
    )


# The reasons' wording.
_REASONS = {
    "Sub-annual sum zero - annual selected": "Sub-annual complete but sum is zero (annual = {annual})",
    "Incomplete sub-annual - annual selected": "Sub-annual incomplete ({count} {periods}) and annual ({annual}) > sub-annual ({sub})",
    "Incomplete sub-annual - sub-annual selected": "Sub-annual incomplete ({count} {periods}) but sub-annual ({sub}) >= annual ({annual})",
    "Annual > sub-annual": "Annual ({annual}) > complete sub-annual ({sub})",
}
_REASON_OF_REST = "Complete sub-annual selected ({share}% of annual)"
_OTHER_SUB, _OTHER_ANNUAL = "Other sub-annual record", "Other annual record"


def _filled_in(wording: str) -> Column:
    """The wording with columns of ``judged`` in place of the names in braces."""
    share = F.regexp_replace(F.round("pct_of_annual", 1).cast("decimal(20,1)").cast("string"), r"\.0$", "")
    values = {"annual": F.col("y.max_sum"), "sub": F.col("s.max_sum"), "count": F.col("s.max_count"), "periods": F.concat(F.lower("s.t_res"), F.lit("s")), "share": F.coalesce(share, F.lit("NA"))}
    parts = [F.lit(text) if k % 2 == 0 else values[text].cast("string") for k, text in enumerate(re.split("[{}]", wording)) if text]
    return F.concat(*parts)


def unselected(levels: DataFrame, *, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """Candidates that weren't taken: series, year, t_res, reason_unselected and the
    category of the choice that it was part of. The best annual and the best sub-annual
    record are compared, so a record of the taken record's own kind, and a sub-annual one
    beside no annual one, is just another record, without a category."""
    reason = _filled_in(_REASON_OF_REST)
    for category, wording in _REASONS.items():
        reason = F.when(F.col("category") == category, _filled_in(wording)).otherwise(reason)
    own = judged(levels, special=special).select("series", "year", F.col("c.t_res").alias("taken"), "two", "category", reason.alias("reason"))
    annual, taken_annual = F.col("t_res") == "Year", F.col("taken") == "Year"
    other = F.when(~F.col("two") | (annual == taken_annual), F.when(annual, _OTHER_ANNUAL).otherwise(_OTHER_SUB))
    rest = levels.join(own, ["series", "year"]).where(F.col("t_res") != F.col("taken"))
    return rest.select("series", "year", "t_res", F.coalesce(other, "reason").alias("reason_unselected"), F.when(other.isNull(), F.col("category")).alias("relationship_category"))


def relationships(levels: DataFrame, *, special: tuple[str, ...] = SPECIAL) -> DataFrame:
    """One row for each series and year with both kinds: how the two compare."""
    own = judged(levels, special=special).where("two")
    return own.select(
        "series", "year", F.col("y.max_sum").alias("annual_sum"), F.col("y.level").alias("annual_level"), F.col("s.max_sum").alias("subannual_sum"), F.col("s.level").alias("subannual_level"),
        F.col("s.t_res").alias("subannual_type"), F.col("s.level_count").alias("subannual_count"), F.col("done").alias("subannual_is_complete"), "pct_of_annual",
        F.col("category").alias("relationship_category"), F.col("c.t_res").alias("selected_type"), F.col("special").alias("is_special_series"),
    )


def relationship_summary(best: DataFrame) -> DataFrame:
    """Number and share of series-years in each category, for those with both kinds."""
    own = best.where(F.col("case") == CASES[2])
    total = own.agg(F.count(F.lit(1)).alias("_n"))
    counted = own.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("series").alias("n_series"))
    return counted.crossJoin(F.broadcast(total)).select("category", "n", "n_series", (100.0 * F.col("n") / F.col("_n")).alias("pct"))


def regional_totals(best: DataFrame, regions: DataFrame) -> DataFrame:
    return best.join(regions, "series", "left").groupBy("region", "year").agg(F.sum("final_sum").alias("total"), F.count(F.lit(1)).alias("n_series"))


def scaling_cases(best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Series-years whose sub-annual counts are to be scaled to the annual total, and the rest."""
    rule = F.coalesce((F.col("category") == "Annual > sub-annual") & F.col("complete") & (F.col("t_res") == "Year"), F.lit(False))
    return best.where(rule), best.where(~rule)


def extract(reports: DataFrame, best: DataFrame, *, nation_sum) -> DataFrame:
    """Reports of the selected resolution and level; units are summed to the nation."""
    level = F.regexp_replace("s_res", "Admin", "a")
    own = reports.withColumn("level", level).join(best.select("series", "year", "t_res", "level"), ["series", "year", "t_res", "level"], "left_semi")
    return nation_sum(own).withColumn("scaled_to_annual", F.lit(False))


def sub_annual_fallback(levels: DataFrame) -> DataFrame:
    """Sub-annual source where none is known: the first level with reports, then the first resolution."""
    rows = levels.where("t_res <> 'Year'").select("series", "year", "t_res", F.expr("stack(3, 'a0', a0_count, 'a1', a1_count, 'a2', a2_count) as (level, n)")).where("n is not null")
    w = Window.partitionBy("series", "year").orderBy("level", "t_res")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("series", "year", "t_res", "level", "n")


def scale_to_total(df: DataFrame, *keys: str, value: str = "value", target: str = "target", order: str = "start_date") -> DataFrame:
    """``scaled``: whole counts in proportion to ``value`` that add up to ``target``.

    Largest remainder in exact decimals: floors, then one more for the largest
    remainders (ties: the earlier date). A null target or a sum of zero leaves the counts.
    """
    w = Window.partitionBy(*keys)
    total = F.sum(value).over(w)
    product = F.col(value).cast("decimal(18,0)") * F.col(target).cast("decimal(18,0)")
    whole = F.expr("_product div _total").cast("bigint")
    out = df.withColumns({"_total": total.cast("decimal(18,0)"), "_product": product})
    usable = F.col(target).isNotNull() & (F.col("_total") > 0)
    out = out.withColumn("_floor", F.when(usable, whole).otherwise(F.col(value)))
    out = out.withColumn("_rest", F.when(usable, F.col("_product") - F.col("_floor").cast("decimal(18,0)") * F.col("_total")))
    out = out.withColumn("_left", F.col(target) - F.sum("_floor").over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc_nulls_last("_rest"), order)))
    more = F.when(usable & (F.col("_k") <= F.col("_left")), 1).otherwise(0)
    return out.withColumn("scaled", F.col("_floor") + more).drop("_total", "_product", "_floor", "_rest", "_left", "_k")


def scaling_audit(df: DataFrame, *keys: str, value: str = "value", target: str = "target") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("sum_before"), F.sum("scaled").alias("sum_after"), F.max(target).alias("target")).withColumn(
        "factor", F.try_divide(F.col("target").cast("double"), F.col("sum_before").cast("double"))
    )


def to_verify(best: DataFrame, regions: DataFrame, *, skip_regions: tuple[str, ...], sources: DataFrame, source_like: str, covered: DataFrame) -> DataFrame:
    """Sub-annual-only series-years outside some regions, whose series has no source
    like the pattern, and that aren't on a list of covered ones."""
    own = best.where(F.col("case") == CASES[1]).join(regions, "series", "left").where(~F.coalesce(F.col("region").isin(*skip_regions), F.lit(False)))
    known = sources.where(F.col("source").like(source_like)).select("series").distinct()
    return own.join(known, "series", "left_anti").join(covered, ["series", "year"], "left_anti").select("series", "year", "region", "category")
