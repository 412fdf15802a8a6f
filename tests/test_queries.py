import pytest

from pointlake.plans.queries import QUERIES, SQL

from .oracle import DATA, compare

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


def test_without_sql(spark):
    assert {n for n in QUERIES if n not in SQL} == {"p1_live_points", "segment_checksums"}
    for name in ("p1_live_points", "segment_checksums"):
        assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10 and set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
