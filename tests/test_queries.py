"""Every registered road query against its SQL; those without SQL are held to other checks, named here."""

import pytest

from corridor.plans import queries, service, surface, surveys  # noqa: F401  all register

#: Fitted models and seeded draws of chips: tests/test_surveys.py, tests/test_models.py.
WITHOUT_SQL = {"mod1_oof", "mod3_ablation", "qry9_traffic_crash_ablation", "mod4_rescale", "mod8_transfer", "mod6_pca", "img3_augment"}
#: Whose answer over the small tables is rightly empty.
EMPTY = {"jon17_overlapping_pairs", "str11_placeholder_cards"}


def test_no_query_without_sql_but_these():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == WITHOUT_SQL and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_every_query_runs_and_matches_its_sql(matches_sql, name):
    n = matches_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert n > 0 or name in EMPTY


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
