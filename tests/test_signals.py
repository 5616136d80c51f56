import random
from datetime import datetime, timedelta

import pytest
from reference_loop import history, rsi

from emberline.operators.candles import BAR, closed_only, newest, numbered
from emberline.operators.signals import SIGNAL, latest_signals, signals

START = datetime(2024, 1, 1)


def series(n, price, volume, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        c = float(price(i, rng))
        out.append({"time": START + timedelta(minutes=5 * i), "open": c, "high": c + rng.random(), "low": c - rng.random(), "close": c, "volume": float(volume(i, rng))})
    return out


def walk(i, rng, state={}):
    state["x"] = 100.0 if i == 0 else state["x"] + rng.uniform(-2, 2)
    return state["x"]


def burst(i, rng):
    return rng.choice([1, 2, 3, 40])


CASES = {f"walk{n}": series(n, walk, burst, n) for n in (1, 2, 9, 13, 14, 15, 16, 19, 20, 21, 299, 300, 301, 1200)}
CASES |= {
    "flat": series(30, lambda i, r: 7.3, burst),
    "rising": series(30, lambda i, r: 10 + i, burst),
    "falling": series(30, lambda i, r: 100 - i, burst),
    "nan": series(340, lambda i, r: float("nan") if i in (5, 40) else walk(i, r), burst, 3),
    "no_volume": series(60, walk, lambda i, r: 0.0, 4),
    "twice": series(40, walk, lambda i, r: 38.0 if i == 39 else 18.0, 5),
    "zero_price": series(60, lambda i, r: r.choice([0.0, 1.0, -1.0]), burst, 6),
}


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(name, "5m", *b.values()) for name, made in CASES.items() for b in made]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, BAR).repartition(3).cache()


@pytest.fixture(scope="module")
def found(bars):
    out = {}
    for r in sorted(signals(bars).collect(), key=lambda r: r["time"]):
        out.setdefault(r["symbol"], []).append(r.asDict())
    return out


def same(a, b):
    return a == b or (a != a and b != b)


@pytest.mark.parametrize("name", CASES)
def test_history_equals_the_loop(found, name):
    expected = history(CASES[name])
    assert len(found[name]) == len(expected)
    for got, want in zip(found[name], expected):
        for column, value in want.items():
            if column in ("ema9", "ema21", "atr", "avg_vol") and value != value:
                assert got[column] != got[column]
            else:
                assert same(got[column], value), (name, got["time"], column, got[column], value)


def test_cases_reach_both_directions(found):
    assert {"BUY", "SELL", "NONE"} == {r["direction"] for rows in found.values() for r in rows}


def test_known_strengths(found):
    assert found["flat"][-1]["rsi"] == found["rising"][-1]["rsi"] == 99.00990099009901
    assert found["falling"][-1]["rsi"] == 0.0
    assert rsi([1.0] * 14) == [50.0] and len(rsi([1.0] * 300)) == 287


def test_properties(found):
    for rows in found.values():
        for r in rows:
            assert 0 <= r["rsi"] <= 100
            assert r["atr"] != r["atr"] or r["atr"] >= 0
            if r["direction"] == "BUY":
                assert r["stop"] <= r["entry"] <= r["take"]
            if r["direction"] == "SELL":
                assert r["take"] <= r["entry"] <= r["stop"]
            assert (r["rr"] == "1:1.5") == (r["entry"] is not None and r["entry"] != 0)


def test_a_spike_must_exceed_twice_the_mean(found):
    last = found["twice"][-1]
    assert last["avg_vol"] * 2 == last["volume"] if "volume" in last else last["avg_vol"] == 19.0
    assert not last["vol_spike"]


def test_scaling_by_a_power_of_two(spark, bars, found):
    scaled = bars.where("symbol IN ('walk300', 'walk1200')").selectExpr("symbol", "interval", "time", "open * 4 AS open", "high * 4 AS high", "low * 4 AS low", "close * 4 AS close", "volume")
    for r in signals(scaled).collect():
        want = found[r["symbol"]][r["n_bars"] - 1 if r["n_bars"] < 300 else [x["time"] for x in found[r["symbol"]]].index(r["time"])]
        assert r["ema9"] == 4 * want["ema9"] and r["rsi"] == want["rsi"]
        assert r["atr"] == (4 * want["atr"] if r["n_bars"] >= 14 else 100)


def test_latest_is_the_last_of_the_history(bars, found):
    latest = {r["symbol"]: r.asDict() for r in latest_signals(bars).collect()}
    assert set(latest) == set(CASES)
    for name, rows in found.items():
        assert all(same(latest[name][c], rows[-1][c]) for c in SIGNAL)


def test_empty_input(spark):
    empty = spark.createDataFrame([], BAR)
    assert signals(empty).count() == 0 and latest_signals(empty).count() == 0
    assert signals(empty).columns == SIGNAL


def test_selection(bars):
    kept = newest(bars, 10).groupBy("symbol").count().collect()
    assert {r["symbol"]: r["count"] for r in kept} == {name: min(10, len(made)) for name, made in CASES.items()}
    assert closed_only(bars).count() == sum(len(x) - 1 for x in CASES.values())
    numbers = numbered(bars.where("symbol = 'walk1200'")).orderBy("time").select("bar_no").collect()
    assert [r[0] for r in numbers] == list(range(1200))


def test_no_single_partition(bars):
    plan = signals(bars)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "SinglePartition" not in plan


def test_chunks_do_not_show(spark, bars, found):
    from emberline.operators.signals import judge
    from emberline.operators.snapshots import with_indicators

    for r in judge(with_indicators(bars.where("symbol IN ('walk301', 'walk1200', 'nan')"), chunk=300)).collect():
        want = next(x for x in found[r["symbol"]] if x["time"] == r["time"])
        assert all(same(r[c], want[c]) for c in SIGNAL)


@pytest.mark.parametrize("column", ["open", "high", "low", "close", "volume"])
def test_null_is_nan(spark, column):
    from emberline.operators.chart import ema_lines, rsi_points

    made = series(60, walk, burst, 8)
    variants = {"null": None, "nan": float("nan")}
    rows = [(name, "5m", *(b | {column: value} if i in (20, 50) else b).values()) for name, value in variants.items() for i, b in enumerate(made)]
    bars = spark.createDataFrame(rows, BAR)
    for table, order in ((signals(bars), "time"), (latest_signals(bars), "time"), (ema_lines(bars), "time"), (rsi_points(bars), "index")):
        by = {name: [repr(r.asDict() | {"symbol": ""}) for r in table.where(f"symbol = '{name}'").orderBy(order).collect()] for name in variants}
        assert by["null"] == by["nan"] and by["nan"]
    expected = history([b | {column: float("nan")} if i in (20, 50) else b for i, b in enumerate(made)])
    for got, want in zip(signals(bars.where("symbol = 'null'")).orderBy("time").collect(), expected, strict=True):
        assert all(same(got[c], v) for c, v in want.items())


def test_odd_rows(spark):
    rows = [(None, "5m", START, 1.0, 1.0, 1.0, float(c), 1.0) for c in (3, 1, 2)] + [("A", None, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    bars = spark.createDataFrame(rows, BAR).selectExpr("*", "1 AS bar_no", "2 AS chunk", "'x' AS home", "3 AS day")
    assert sorted(r["n_bars"] for r in signals(bars).collect()) == [1, 1, 2, 3]
    assert [r["close"] for r in numbered(bars.where("symbol IS NULL")).orderBy("bar_no").collect()] == [1.0, 2.0, 3.0]
    assert closed_only(bars).count() == 0 and latest_signals(bars).count() == 2


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_ticks_of_one_time_are_ordered(spark, kind):
    from emberline.operators.candles import from_ticks

    top = 2**63 - 1
    rows = [("2024-01-01 00:00:01", i, float(v)) for v, i in enumerate((5, 3, None, 7))] + [("2024-01-01 00:00:02", top, 9.0), ("2024-01-01 00:00:02.000001", -top, 11.0), ("2024-01-01 00:04:00", 1, None), (None, 1, 1.0)]
    ticks = spark.createDataFrame(rows, "ts string, event_id bigint, value double").selectExpr("CAST(ts AS timestamp_ntz) AS ts", f"CAST(event_id AS {kind}) AS event_id", "value")
    found = from_ticks(ticks, "1m").orderBy("time").collect()
    assert [(r["open"], r["close"], r["volume"]) for r in found][0] == (2.0, 11.0, 6.0)
    assert found[1]["open"] != found[1]["open"] and len(found) == 2
