"""Every registered query of the library against its SQL."""

import os

import duckdb
import pytest

from quarry.plans import queries as library


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, sf_dir, name):
    found = library.QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    rows = sorted(map(repr, map(tuple, found.select(*columns).collect())))
    assert rows
    if name in library.ORACLES:
        with duckdb.connect() as db:
            for t in os.listdir(sf_dir):
                db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
            expected = db.execute(library.ORACLES[name])
            names = [d[0] for d in expected.description]
            assert sorted(names) == columns
            assert rows == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
