import duckdb
import pytest

import __spark_entry__ as entry
from emberline.plans import oracle, queries, streams

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries() | streams.queries()))
def test_query_equals_its_sql(spark, name):
    frame = entry.queries()[name](spark, SF)
    found = [r.asDict() for r in frame.collect()]
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
        expected = db.execute(oracle.oracle_sql()[name])
        names = [d[0] for d in expected.description]
        rows = expected.fetchall()
    columns = sorted(names)
    assert sorted(frame.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in found) == sorted(repr([r[names.index(c)] for c in columns]) for r in rows)


def test_every_core_query_has_sql():
    assert set(queries.queries() | streams.queries()) == set(oracle.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
