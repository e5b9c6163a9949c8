import pytest
from oracle import compare, connect

from inkstream.llm import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, con, sf_dir, name):
    compare(spark, con, sf_dir, queries.QUERIES[name], queries.SQL[name])


COLUMNS = {
    "p1_found": {"first_bib_id": "bigint", "bib_id": "bigint"},
    "p2_found": {"field": "string", "row_id": "bigint"},
    "p3_found": {"node_uid": "bigint"},
    "p5_found": {"key_a": "string", "key_b": "string"},
    "p6_found": {"field": "string", "row_id": "bigint", "markup": "string"},
    "p7_found": {"field": "string", "row_id": "bigint", "lang": "string"},
    "p10_found": {"doc_id_a": "bigint", "doc_id_b": "bigint"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_set(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))
    assert all(v is not None for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(COLUMNS) - set(queries.SQL)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0
