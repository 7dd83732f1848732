"""Key screens: fuse filters of a key set, sent to all executors up to a proven size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countloom.llm import fuse
from countloom.llm.common import saved

#: Parts of a screen's filters. Keys of a screen that is sent to every executor, at some nine
#: bits a key: 18 MB. Beyond it a join, which shuffles what the screen would have let pass; the rows
#: are the same either way.
PARTS, MOST_SENT_KEYS = 256, 16_000_000


def build_filters(keys: DataFrame, parts: int) -> DataFrame:
    """part, n, seed, cells: a filter of the keys (column key, long) of each part."""

    def build(part: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(pdf["key"].to_numpy().astype(np.uint64))
        seed, cells = fuse.build(own)
        return pd.DataFrame({"part": [part[0]], "n": [len(own)], "seed": [seed], "cells": [cells]})

    return keys.select(part_of("key", parts), "key").groupBy("part").applyInPandas(build, "part long, n long, seed long, cells binary")


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.col(key), F.lit(parts)).alias("part")


def screen_of(keys: DataFrame):
    """A function from a key column to "may be among the keys", or None if there are
    more than ``MOST_SENT_KEYS``: then a join has to do all the work."""
    keys = saved(keys.select("key").distinct(), "keys")
    if keys.count() > MOST_SENT_KEYS:
        return None
    filters = {r["part"]: (r["n"], r["seed"], r["cells"]) for r in build_filters(keys, PARTS).collect()}
    sent = keys.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("boolean")
    def maybe(key: pd.Series) -> pd.Series:
        own = key.to_numpy()
        out = np.zeros(len(own), bool)
        parts = own % PARTS
        for part in np.unique(parts).tolist():
            if part in sent.value:
                here = parts == part
                out[here] = fuse.contains(own[here].astype(np.uint64), *sent.value[part])
        return pd.Series(out)

    return maybe


def without(df: DataFrame, gone: DataFrame, condition: Column, key: Column, gone_key: Column) -> DataFrame:
    """``df`` without the rows that ``condition`` matches with ``gone``. Rows whose key
    the screen knows not to be gone pass in a narrow stage; the others are joined."""
    maybe = screen_of(gone.select(gone_key.alias("key")))
    if maybe is None:
        return df.join(gone, condition, "left_anti")
    return df.where(~maybe(key)).unionByName(df.where(maybe(key)).join(gone, condition, "left_anti"))
