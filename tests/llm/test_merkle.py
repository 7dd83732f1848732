"""Operator 13 against a plain tree, and its odd cases."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from countloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, seg long, at string, tree int"
LONG = "Ünd mehr\n" * 50_000
ODD = [
    (1, None, None, None, None, 1, "x", 1),
    (2, "", "en", "", 0, 2, None, None),
    (3, "twice\nover", "en", "a", 10, 3, "y", 3),
    (3, "twice\nover", "en", "a", 10, 3, "y", 3),
    (3, "twice\nover\n!", "en", "a", 10, 3, "y", 3),
    (None, "no id", "de", "a", 5, 4, "z", 4),
    (None, None, None, None, None, None, None, None),
    (8, LONG, "de", "é", len(LONG), 5, "w", 5),
    *((k, f"text {k}\n", "en", "hot", k, k, "v", k) for k in range(100, 141)),
]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def brute(rows, shown):
    groups = defaultdict(list)
    for row in rows:
        groups[row[3]].append((row[0] is not None, row[0] or 0, leaf(row, row[1]), leaf(row, shown(row))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([r[2] for r in sorted(groups[g])]) for g in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for s, g in enumerate(order):
        for pos, (known, doc_id, own, presented) in enumerate(sorted(groups[g])):
            siblings, digest = [], presented
            for tree, at in ((trees[s], pos), (top, s)):
                for row in tree[:-1]:
                    low = at - at % 3
                    left, right = row[low:at], row[at + 1 : low + 3]
                    siblings += left + right
                    digest, at = h(*left, digest, *right), at // 3
            out.append((doc_id if known else None, own, trees[s][-1][0], top[-1][0], "".join(siblings), digest, digest == top[-1][0]))
    return sorted(out, key=repr)


def run(df, **shown):
    rows = merkle.proofs(merkle.build(df, **shown)).collect()
    return sorted(((r.doc_id, *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "proof", "folded_root")), r.verified) for r in rows), key=repr)


@pytest.mark.parametrize("levels_, segment", [(7, 4096), (1, 4), (2, 5), (2, 1)])
def test_against_plain_trees(spark, monkeypatch, levels_, segment):
    """Nulls, empty and long texts, repeated rows and ids, clashing names, for any size of block and segment."""
    monkeypatch.setattr(merkle, "LEVELS", levels_)
    monkeypatch.setattr(merkle, "SEGMENT", segment)
    df = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    cut = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    shown = lambda r: r[1].replace("\n", "") if r[0] is not None and r[0] % 2 == 0 and r[1] is not None else r[1]
    got = run(df, presented={"text": cut})
    assert got == brute(ODD, shown)
    assert {r[0] for r in got if not r[-1]} == {r[0] for r in ODD if shown(r) != r[1]}


def test_one_group_one_leaf_and_no_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for part in (ODD[:1], ODD[2:5], ODD[8:9], ODD[8:11], ODD[:2]):
        assert run(spark.createDataFrame(part, SCHEMA)) == brute(part, lambda r: r[1])
    made = merkle.build(df.limit(0))
    assert made.root is None and merkle.proofs(made).count() == 0


def test_missing_nodes_are_least():
    """Brute force over all ranges: what the range can't derive itself, and no more."""
    for n in range(1, 40):
        for a in range(n):
            for b in range(a, n):
                own, want, size, level = set(range(a, b + 1)), set(), n, 0
                while size > 1:
                    runs = {k // 3 for k in own}
                    want |= {(level, k) for r in runs for k in range(3 * r, min(3 * r + 3, size)) if k not in own}
                    own, size, level = runs, -(-size // 3), level + 1
                got = merkle.missing_of(a, b, n)
                assert len(got) == len(set(got)) and set(got) == want


def test_any_change_of_a_row_shows(spark):
    rows = ODD[8:30]
    root = merkle.build(spark.createDataFrame(rows, SCHEMA)).root
    assert merkle.build(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).root == root
    for at, value in ((0, 7), (1, "other"), (2, None), (3, "b"), (4, 99)):
        changed = [tuple(value if k == at else v for k, v in enumerate(rows[3])), *rows[:3], *rows[4:]]
        assert merkle.build(spark.createDataFrame(changed, SCHEMA)).root != root
