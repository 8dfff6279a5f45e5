"""Every catalog query against its SQL."""

import duckdb
import pytest

from folioscope.plans import catalog, oracle

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return c


def test_all_have_sql_but_json_bundles_and_files():
    assert set(catalog.QUERIES) - set(oracle.SQL) == {"consult_bundle", "markdown_round_trip"}


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, tables, db, name):
    df = catalog.QUERIES[name](spark, tables)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = db.sql(oracle.SQL[name])
    assert sorted(rel.columns) == columns
    expected = sorted((tuple(dict(zip(rel.columns, r, strict=True))[c] for c in columns) for r in rel.fetchall()), key=repr)
    assert found == expected


def test_bundles(spark, tables):
    rows = {r.qid: r for r in catalog.QUERIES["consult_bundle"](spark, tables).collect()}
    assert len(rows) == 6 and rows[4].n_core == rows[4].n_related == rows[4].n_topics == 0
    assert rows[2].n_core > 0 and rows[1].n_topics == 6
