"""Every query with SQL gives the rows of its SQL; the others give rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from countloom.plans import queries_jobs, queries_select, queries_series, queries_time, registry  # noqa: E402, F401
from tests.compare import connect, differences  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLE_SQL:
        assert not differences(df, con, registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_every_query_but_random_and_fitted_ones_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"i_draw_counts", "w3_publish_months", "k_count_model", "k_model_scores"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    names = ["f_best_records", "f_scale_to_total", "e_drop_losing_spans", "e_drop_smallest", "h_fill_gaps", "g_impute_nearest", "i_rake", "i_draw_counts"]
    rows = lambda name: sorted(map(repr, registry.QUERIES[name](spark, sf_dir).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = {name: rows(name) for name in names}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert {name: rows(name) for name in names} == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
