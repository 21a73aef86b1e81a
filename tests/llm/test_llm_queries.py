import pytest

from marginalia.llm import queries

NAMES = sorted(queries.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_has_the_rows_of_its_sql(name, compare, data, tmp_path):
    mine, theirs = compare(queries.queries()[name], queries.oracle_sql()[name], data, tmp_path / name)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(NAMES)))
def test_query_runs(name, spark, data):
    assert queries.queries()[name](spark, data).count() >= 0


def test_nothing_outside_imports_the_subpackage():
    from pathlib import Path

    root = Path(queries.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if p.parent.name != "llm" and "marginalia.llm" in p.read_text()]
