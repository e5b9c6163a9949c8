import pytest
from oracle import compare, connect

from inkstream.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, sf_dir, name):
    compare(spark, con, sf_dir, catalogue.queries()[name], catalogue.oracle_sql()[name])


#: Queries that may find nothing in tables as small as these.
SPARSE = {"broken_anchors", "numbered_footnotes", "removed_commands", "html_table_models", "all_boxes"}


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0 or name in SPARSE


def test_entry_works_alone():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
