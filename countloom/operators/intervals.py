"""Spans of time: which rows lie within one, by equality joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.sources.shared import saved


def _bucket(day: Column, width: int) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / width)


def mean_width(spans: DataFrame, low: str, high: str) -> int:
    """Days of a bucket: the mean length of the spans, a week at least. A span touches its length over
    the width and two buckets more at most, so all spans together no more than three times their number."""
    mean = spans.agg(F.avg(F.datediff(high, low))).first()[0]
    return max(int(mean or 0) + 1, 7)


def outside(
    df: DataFrame, spans: DataFrame, *, on: tuple[str, ...] = (), null_safe: tuple[str, ...] = (), start: str = "start_date", end: str = "end_date", low: str = "from_date", high: str = "to_date",
    width: int | None = None, inside: bool = False,
) -> DataFrame:
    """Rows of ``df`` that lie within no span (``inside``: within one at least) with the same ``on`` and
    ``null_safe`` columns: ``low`` <= ``start`` and ``end`` <= ``high``. For ``null_safe`` ones two nulls are the same.

    Each span is put into all time buckets that it touches, a row into that of its start, so the join is on equal
    keys and buckets, and the dates are tested within it. The rows aren't multiplied. A row without
    dates, or that ends before it starts, lies within no span; a span without dates, or that ends before it starts,
    holds nothing.
    """
    spans = spans.where(F.col(low) <= F.col(high)).select(*on, *null_safe, low, high).distinct()
    width = width or mean_width(spans, low, high)
    names = {name: f"_r_{name}" for name in (*on, *null_safe, low, high)}
    buckets = F.sequence(_bucket(F.col(low), width), _bucket(F.col(high), width))
    own = spans.withColumn("_r_bucket", F.explode(buckets)).select("_r_bucket", *(F.col(name).alias(new) for name, new in names.items()))
    rule = (_bucket(F.col(start), width) == F.col("_r_bucket")) & (F.col(start) >= F.col(names[low])) & (F.col(start) <= F.col(end)) & (F.col(end) <= F.col(names[high]))
    for name in on:
        rule = rule & (F.col(name) == F.col(names[name]))
    for name in null_safe:
        rule = rule & F.col(name).eqNullSafe(F.col(names[name]))
    return df.join(own, rule, "left_semi" if inside else "left_anti")


def _sources_of(df: DataFrame, rules: DataFrame) -> DataFrame:
    """source_like, source: the sources of ``df`` that each pattern fits. Patterns meet sources by their
    text before the first wildcard, then LIKE decides, on distinct values of both."""
    head = F.regexp_extract("source_like", r"^[^%_\\]*", 0)
    patterns = rules.select("source_like").where("source_like is not null").distinct().withColumn("_head", head)
    sources = df.select("source").where("source is not null").distinct()
    sources = sources.withColumn("_head", F.explode(F.transform(F.sequence(F.lit(0), F.length("source")), lambda n: F.substring("source", F.lit(1), n))))
    return sources.join(patterns, "_head").where(F.expr("source LIKE source_like")).select("source_like", "source").distinct()


#: Fields of a rule that a row must equal, where they are given.
FIELDS = ("series", "year", "t_res", "source")


def exclude(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Drops rows that fit a rule. A rule's fields are series, year, t_res, from_date,
    to_date and source_like; a null field fits everything, a null value nothing.

    Patterns of sources become sources first. Rules are then taken by the fields that they give (sixteen sets at most, found
    by one small aggregate), for each set an equality join on these: with both dates by time buckets; with one date
    only the earliest from and the latest to of a key matter; rules without any field are a comparison with
    one value. No rule makes a nested loop, and no row of ``df`` is multiplied.
    """
    plain = rules.where("source_like is null").withColumn("source", F.lit(None).cast("string"))
    liked = rules.join(_sources_of(df, rules), "source_like")
    own = saved(plain.unionByName(liked).select(*FIELDS, "from_date", "to_date").distinct(), "rules")
    given = [F.col(name).isNotNull().alias(name) for name in (*FIELDS, "from_date", "to_date")]
    kinds = own.groupBy(*given).count().collect()  # 64 rows at most
    for kind in sorted(kinds, key=lambda row: tuple(row)):
        keys = [name for name in FIELDS if kind[name]]
        fits = F.lit(True)
        for name in (*FIELDS, "from_date", "to_date"):
            fits = fits & (F.col(name).isNotNull() if kind[name] else F.col(name).isNull())
        part = own.where(fits)
        if kind["from_date"] and kind["to_date"]:
            df = outside(df, part, on=tuple(keys))
            continue
        best = part.groupBy(*keys).agg(F.min("from_date").alias("_from"), F.max("to_date").alias("_to"))
        late = F.lit(True) if not kind["from_date"] else F.col("start_date") >= F.col("_from")
        early = F.lit(True) if not kind["to_date"] else F.col("end_date") <= F.col("_to")
        if keys:
            best = best.select(*(F.col(name).alias(f"_r_{name}") for name in keys), "_from", "_to")
            rule = late & early
            for name in keys:
                rule = rule & (F.col(name) == F.col(f"_r_{name}"))
            df = df.join(best, rule, "left_anti")
        elif kind["from_date"]:
            df = df.where(~F.coalesce(F.col("start_date") >= best.select("_from").scalar(), F.lit(False)))
        elif kind["to_date"]:
            df = df.where(~F.coalesce(F.col("end_date") <= best.select("_to").scalar(), F.lit(False)))
        else:
            df = df.where(F.lit(False))
    return df
