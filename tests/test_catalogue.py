import pytest

from tests.compare import check
from tessera.plans import catalogue, values  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    check(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], SF)


def test_entry_is_registered():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["time_and_zone", "date_constructors", "duration_components"])
def test_texts_are_read_in_many_tasks(spark, monkeypatch, name):
    """Tables of few bytes are one part of a file, however many texts come of them."""
    monkeypatch.setattr(values, "_TASK_TEXTS", 50)
    found = catalogue.QUERIES[name](spark, SF)
    assert found.rdd.getNumPartitions() > 3
    check(found, catalogue.ORACLE_SQL[name], SF)
