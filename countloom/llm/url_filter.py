"""Operator 7: URL filter by host rules and a weighted vocabulary."""

from __future__ import annotations

import re
from functools import lru_cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from countloom.llm.common import map_batches, table

#: (host/path prefix, verdict). A rule holds for its host and all subdomains.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: A URL is rejected when the weights of its different terms reach this.
LIMIT = 1.0


def default_terms() -> dict[str, float]:
    """The vocabulary of ``url_terms.csv``: a term of weight 1 is strict, as it rejects
    alone; a lighter one is soft."""
    lines = files("countloom.llm").joinpath("url_terms.csv").read_text("utf-8").splitlines()[1:]
    return {term: float(weight) for term, weight in (line.split(",") for line in lines)}


def terms_of(table: DataFrame) -> dict[str, float]:
    """A vocabulary from a table (term, weight); of a term's weights the largest counts. Nulls, empty
    terms and weights that aren't positive are left out. A user's list, so it is collected."""
    rows = table.select(F.lower(F.col("term").cast("string")), F.col("weight").cast("double")).where("weight > 0").collect()
    found: dict[str, float] = {}
    for term, weight in rows:
        if term:
            found[term] = max(weight, found.get(term, 0.0))
    return found


_WORD = re.compile(r"[0-9a-z]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.match(r"[^/?#]*", rest, re.S).group()
    path = re.match(r"[^?#]*", rest[len(host) :], re.S).group()
    return host.translate(_LOWER), path


_LOWER = {code: code + 32 for code in range(ord("A"), ord("Z") + 1)}


@lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, float], ...]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, weight in terms:
        automaton.add_word(term, (term, weight))
    automaton.make_automaton()
    return automaton


def found_terms(url: str | None, terms: tuple[tuple[str, float], ...]) -> dict[str, float]:
    """The different terms in the URL that stand as whole words (no letter or digit touches
    them on either side), with their weights."""
    if not url or not terms:
        return {}
    text = url.translate(_LOWER)
    hits: dict[str, float] = {}
    for end, (term, weight) in _automaton(terms).iter(text):
        start = end - len(term) + 1
        if (start == 0 or not _WORD.match(text[start - 1])) and (end + 1 == len(text) or not _WORD.match(text[end + 1])):
            hits[term] = weight
    return hits


def matched_rule(host: str, path: str, rules) -> tuple[str, str] | None:
    """The longest rule that fits, as (rule, verdict); of equally long ones the first in the list."""
    best = None
    for rule, verdict in rules:
        own, slash, prefix = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + prefix) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


def filter_urls(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, terms: dict[str, float] | DataFrame | None = None, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``df``: page_id, host, path, rule, verdict, n_strict, n_soft, weight.

    The longest fitting rule decides (of equally long ones the first in the list); without one,
    an Aho-Corasick pass over the whole URL finds the different terms that stand as whole words, and
    the URL is blocked if their weights reach ``limit``: one strict term (of that weight) or
    several soft ones. ``terms`` maps terms in small letters to weights, or is a table (term, weight);
    by default ``url_terms.csv``. One narrow stage that reads the id and the URL only.

    A null URL or one without ``://`` has an empty host and path and no rule; its
    terms still count. A null id stays null, repeated rows give repeated results,
    other columns are ignored, an empty table gives an empty result.
    """
    found = default_terms() if terms is None else terms_of(terms) if isinstance(terms, DataFrame) else terms
    own_terms, rules = tuple(sorted(found.items())), tuple(rules)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for url in batch.column(1).to_pylist():
            host, path = split_url(url)
            hits = list(found_terms(url, own_terms).values())
            n_strict, weight = sum(w >= limit for w in hits), sum(sorted(hits))
            rule, verdict = matched_rule(host, path, rules) or (None, "block" if weight >= limit else "allow")
            out.append((host, path, rule, verdict, n_strict, len(hits) - n_strict, float(weight)))
        columns = list(map(list, zip(*out))) if out else [[]] * 7
        kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.float64()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "weight"])

    own = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return map_batches(own, step, "page_id long, host string, path string, rule string, verdict string, n_strict int, n_soft int, weight double")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FOUND = "[t.w FOR t IN {terms} IF regexp_matches(low, '(^|[^0-9a-z])' || t.t || '($|[^0-9a-z])')]"
_TERMS = [{"t": term, "w": weight} for term, weight in sorted(default_terms().items())]

OP7_SQL = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), {_LETTERS}) AS low, instr(coalesce(url, ''), '://') AS mark FROM pages),
s AS (SELECT *, CASE WHEN mark > 0 THEN substr(url, mark + 3) ELSE '' END AS rest FROM u),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM s),
x AS (SELECT page_id, low, translate(raw_host, {_LETTERS}) AS host, regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT * FROM (VALUES {", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES)}) r(rule, verdict)),
m AS (
  SELECT page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS ruled
  FROM x JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, instr(rule, '/'))) GROUP BY page_id
), c AS (SELECT x.*, {_FOUND.format(terms=_TERMS)} AS hits FROM x),
d AS (SELECT *, CAST(len([w FOR w IN hits IF w >= {LIMIT}]) AS INTEGER) AS n_strict, CAST(len(hits) AS INTEGER) AS n, CAST(coalesce(list_sum(hits), 0) AS DOUBLE) AS weight FROM c)
SELECT d.page_id, host, path, rule, coalesce(ruled, CASE WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, n_strict, n - n_strict AS n_soft, weight FROM d LEFT JOIN m ON m.page_id = d.page_id
"""
