import random
from datetime import datetime, timedelta

import pytest

from emberline.functions import table
from emberline.operators.candles import BAR
from emberline.operators.snapshots import with_indicators


@pytest.fixture(scope="module")
def view(spark):
    rng, rows = random.Random(6), []
    for name, n in (("A", 5000), ("B", 1), (None, 320), ("C", 15)):
        for i in range(n):
            price = 100 + rng.gauss(0, 3)
            rows.append((name, "1m", datetime(2024, 1, 1) + timedelta(minutes=i), price, price + 1, price - 1, None if rng.random() < 0.001 else price, float(rng.randint(0, 9))))
    rows.append(rows[7])
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, BAR).cache()
    frame.selectExpr("*", "1 AS extra").createOrReplaceTempView("some_bars")
    table.register(spark)
    return frame


@pytest.mark.parametrize("size", [None, 1, 120])
def test_equal_to_the_operator(spark, view, size):
    found = spark.sql(f"SELECT * FROM candle_indicators(TABLE(some_bars){'' if size is None else f', {size}'})")
    want = with_indicators(view) if size is None else with_indicators(view, size)
    assert found.columns == want.columns
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert rows(found) == rows(want)


def test_nothing_and_other_tables(spark, view):
    assert spark.sql("SELECT * FROM candle_indicators(TABLE(SELECT * FROM some_bars WHERE false))").count() == 0
    for call in ("TABLE(SELECT 1 AS x)", "1", "TABLE(some_bars), 0", "TABLE(some_bars), NULL"):
        with pytest.raises(Exception, match="table|size"):
            spark.sql(f"SELECT * FROM candle_indicators({call})").collect()
