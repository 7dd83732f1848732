"""Place names that aren't written alike: an index of their q-grams proposes, edit distance decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countloom.sources.shared import saved

#: Length of a gram, and the lengths of a name from which one and two edits are allowed.
Q, EDITS_FROM = 2, (4, 8)


def normal(name: Column) -> Column:
    """In capitals, with single blanks for everything but letters and digits; empty for null."""
    return F.coalesce(F.trim(F.upper(F.regexp_replace(name, r"[^\p{L}\p{N}]+", " "))), F.lit(""))


def edits_allowed(name: Column) -> Column:
    return sum((F.when(F.length(name) >= least, 1).otherwise(0) for least in EDITS_FROM), F.lit(0))


def grams(name: Column, q: int = Q) -> Column:
    """(gram, how many of the same came before it) of the padded name, so that repeated grams
    count as often as they occur. A name of n characters has n + q - 1."""
    pad = "\x00" * (q - 1)
    all_ = F.transform(F.sequence(F.lit(1), F.length(name) + q - 1), lambda k: F.substring(F.concat(F.lit(pad), name, F.lit(pad)), k, F.lit(q)))
    return F.transform(all_, lambda gram, k: F.struct(gram.alias("gram"), F.size(F.filter(F.slice(all_, F.lit(1), k), lambda other: other == gram)).alias("nth")))


def match_names(names: DataFrame, codes: DataFrame, *, raw: str = "raw_name", q: int = Q) -> DataFrame:
    """One row a distinct raw name: raw_name, status, iso, name, distance, candidates.

    ``codes`` holds name and iso, several names a code if need be. Names are compared in their normal form; up to
    one edit (insertion, deletion, other character) is allowed from 4 characters on, two from 8. The least
    distance wins: status ``exact`` (0) or ``fuzzy``, and ``ambiguous`` if it is that of several codes, which
    ``candidates`` lists, without iso and name; ``unknown`` if no name is near enough. Of several names of the
    winning code the first in order is given. Null and empty names are unknown.

    A name with k edits keeps all but k * q of its grams, so it shares one of any k * q + 1 of them: only a raw name's rarest
    k * q + 1 grams, by their number in the index, are looked up. That loses nothing, and common grams
    are hardly ever looked up. Everything runs on distinct names; the facts are joined with the result by equality.
    """
    own = names.select(F.col(raw).alias("raw_name")).where(F.col(raw).isNotNull()).distinct()
    own = saved(own.withColumn("n_raw", normal(F.col("raw_name"))).withColumn("k", edits_allowed(F.col("n_raw"))), "names")
    known = codes.select("name", "iso").where("name is not null and iso is not null").distinct().withColumn("n_name", normal(F.col("name"))).where("n_name <> ''")
    index = saved(known.select("name", "iso", "n_name", F.explode(grams(F.col("n_name"), q)).alias("g")), "grams")
    often = index.groupBy("g").agg(F.count(F.lit(1)).alias("often"))
    asked = own.where("n_raw <> ''").select("n_raw", "k").distinct().select("n_raw", "k", F.explode(grams(F.col("n_raw"), q)).alias("g"))
    asked = asked.join(often, "g", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    rarest = Window.partitionBy("n_raw").orderBy("often", "g")  # the grams of one name
    asked = asked.withColumn("_at", F.row_number().over(rarest)).where((F.col("_at") <= F.col("k") * q + 1) & (F.col("often") > 0))
    pairs = asked.join(index, "g").where(F.abs(F.length("n_raw") - F.length("n_name")) <= F.col("k"))
    pairs = pairs.select("n_raw", "k", "n_name", "name", "iso").distinct()
    near = pairs.withColumn("distance", F.levenshtein("n_raw", "n_name")).where(F.col("distance") <= F.col("k"))
    by_iso = near.groupBy("n_raw", "iso").agg(F.min(F.struct("distance", "name")).alias("b"))
    least = Window.partitionBy("n_raw")
    by_iso = by_iso.withColumn("_d", F.min("b.distance").over(least)).where("b.distance = _d")
    best = by_iso.groupBy("n_raw").agg(F.min("_d").alias("distance"), F.sort_array(F.collect_set("iso")).alias("candidates"), F.min("b.name").alias("_name"))
    one = F.size("candidates") == 1
    status = F.when(F.col("candidates").isNull(), "unknown").when(~one, "ambiguous").when(F.col("distance") == 0, "exact").otherwise("fuzzy")
    out = own.join(best, "n_raw", "left").withColumn("status", status)
    return out.select("raw_name", "status", F.when(one, F.col("candidates")[0]).alias("iso"), F.when(one, F.col("_name")).alias("name"), "distance", "candidates")


def add_code_near(df: DataFrame, codes: DataFrame, *, name: str = "series") -> DataFrame:
    """``df`` with iso, matched_name, match_status of the nearest known name; rows without a
    name are unknown."""
    found = match_names(df, codes, raw=name).select(F.col("raw_name").alias(name), "iso", F.col("name").alias("matched_name"), F.col("status").alias("match_status"))
    return df.join(found, name, "left").withColumn("match_status", F.coalesce("match_status", F.lit("unknown"))).select(*df.columns, "iso", "matched_name", "match_status")


def to_review(matches: DataFrame) -> DataFrame:
    """Names that a person has to decide: ambiguous ones with their candidates, and unknown ones."""
    return matches.where("status in ('ambiguous', 'unknown')").select("raw_name", "status", "candidates")
