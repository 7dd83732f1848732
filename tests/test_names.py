"""Fuzzy place names against all pairs."""

import random

import pytest

from countloom.operators import names


def normal(text):
    out = "".join(c if c.isalnum() else " " for c in (text or "")).upper().split()
    return " ".join(out)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(raws, codes):
    out = {}
    for raw in raws:
        n = normal(raw)
        k = (len(n) >= 4) + (len(n) >= 8)
        near = [(distance(n, normal(name)), iso, name) for name, iso in codes if name and iso and normal(name) and n]
        near = [x for x in near if x[0] <= k]
        d = min((x[0] for x in near), default=None)
        isos = sorted({x[1] for x in near if x[0] == d})
        status = "unknown" if not isos else "ambiguous" if len(isos) > 1 else "exact" if d == 0 else "fuzzy"
        one = len(isos) == 1
        out[raw] = (status, isos[0] if one else None, min(x[2] for x in near if x[0] == d) if one else None, d, isos or None)
    return out


def edited(rng, text):
    for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
        at = rng.randrange(len(text) + 1)
        kind = rng.random()
        text = text[:at] + rng.choice("AEIX ") + text[at:] if kind < 0.33 else text[:at] + text[at + 1 :] if kind < 0.66 else text[:at] + rng.choice("OUTZ") + text[at + 1 :]
    return text


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    """Repeated grams, short names, several names of a code, one name of two codes, other alphabets, nulls."""
    rng = random.Random(seed)
    codes = [("".join(rng.choice("ABANTO") for _ in range(rng.choice([2, 3, 5, 8, 12]))), f"I{k % 40}") for k in range(60)]
    codes += [("Côte d'Ivoire", "CIV"), ("Ivory Coast", "CIV"), ("Viet Nam", "VNM"), ("ประเทศไทย", "THA"), ("Congo", "COG"), ("Congo", "COD"), (None, "X"), ("Y", None), ("--", "Z"), ("AAAAAAAAAA", "A10")]
    raws = {edited(rng, name) for name, _ in codes if name for _ in range(4)} | {"", "  ", "viet-nam", "VIETNAM", "cote d ivoire", "ประเทศไท", "Congo", "AAAAAAAA", "AAAAAAAAAAAA"}
    df = spark.createDataFrame([(r,) for r in raws] + [(None,), ("Congo",)], "raw_name string").repartition(3)
    want = brute(raws, codes)
    got = {r.raw_name: (r.status, r.iso, r.name, r.distance, r.candidates) for r in names.match_names(df, spark.createDataFrame(codes, "name string, iso string")).collect()}
    assert got == want and {s for s, *_ in want.values()} == {"exact", "fuzzy", "ambiguous", "unknown"}


def test_codes_on_rows(spark):
    codes = spark.createDataFrame([("BRAZIL", "BRA"), ("PERU", "PER"), ("NIGER", "NER"), ("NIGERIA", "NGA")], "name string, iso string")
    df = spark.createDataFrame([("Brasil", 1), ("Perú", 2), ("NIGERI", 3), (None, 4), ("Brasil", 5), ("nowhere", 6)], "series string, value int")
    got = {r.value: (r.series, r.iso, r.match_status) for r in names.add_code_near(df, codes).collect()}
    assert got == {1: ("Brasil", "BRA", "fuzzy"), 5: ("Brasil", "BRA", "fuzzy"), 2: ("Perú", "PER", "fuzzy"), 3: ("NIGERI", None, "ambiguous"), 4: (None, None, "unknown"), 6: ("nowhere", None, "unknown")}
    review = names.to_review(names.match_names(df, codes, raw="series")).collect()
    assert {(r.raw_name, tuple(r.candidates or ())) for r in review} == {("NIGERI", ("NER", "NGA")), ("nowhere", ())}
    assert names.match_names(df.limit(0), codes, raw="series").isEmpty() and names.match_names(df, codes.limit(0), raw="series").where("status <> 'unknown'").isEmpty()


def test_common_grams_are_not_looked_up(spark):
    """Names that all begin alike: candidates stay near the number of names, not its square."""
    codes = spark.createDataFrame([(f"PROVINCE OF {k * 7919 % 100003:05d}", str(k)) for k in range(3000)], "name string, iso string")
    raws = codes.selectExpr("translate(name, 'V', 'B') AS raw_name")
    got = names.match_names(raws, codes)
    assert got.count() == 3000 and got.where("status = 'fuzzy'").count() + got.where("status = 'ambiguous'").count() == 3000
