import duckdb
import pytest

import __spark_entry__ as entry
from emberline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    found = entry.queries()[name](spark, SF)
    with duckdb.connect() as db:
        for table in ("documents", "pages"):
            db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        expected = db.sql(entry.oracle_sql()[name])
        assert sorted(expected.columns) == sorted(found.columns)
        assert sorted(expected.select(*found.columns).fetchall(), key=repr) == sorted(map(tuple, found.collect()), key=repr)
