"""Every registered query against its SQL."""

import oracle
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    sql = entry.oracle_sql().get(name)
    if sql:
        assert oracle.difference(df, con, sql) is None
    else:  # their results are tested beside the operators; here the whole query runs
        rows = df.collect()
        assert rows and len(set(df.columns)) == len(df.columns)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name,column", [("o1_sorted_export", "sku"), ("o2_sorted_completed_urls", "url")])
def test_sorted_queries_come_in_order(spark, sf_dir, name, column):
    values = [r[column] for r in entry.queries()[name](spark, sf_dir).collect()]
    assert values == sorted(values) and len(values) > 10
