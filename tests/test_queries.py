import pytest

from marginalia import queries

NAMES = sorted(queries.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_has_the_rows_of_its_sql(name, compare, data, tmp_path):
    mine, theirs = compare(queries.queries()[name], queries.oracle_sql()[name], data, tmp_path / name)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(NAMES)))
def test_query_runs(name, spark, data):
    assert queries.queries()[name](spark, data).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
