import math
import random
from datetime import datetime, timedelta

import pytest

from emberline.operators import outcomes
from emberline.operators.asof import as_of
from emberline.operators.candles import BAR, every_interval, from_ticks, merge_bars, newest_versions, partial_bars
from emberline.operators.history import full_history
from emberline.operators.outcomes import first_touches

START = datetime(2024, 1, 1)


def looped(closes):
    """(ema9, ema21, prev_ema9, prev_ema21, rsi) after each close, by a plain loop."""
    out, average, gain, loss, gains, losses = [], {9: None, 21: None}, 0.0, 0.0, [], []
    for i, close in enumerate(closes):
        before = dict(average)
        for period in average:
            k = 2.0 / (period + 1)
            average[period] = close * k + average[period] * (1.0 - k) if i else close
        if i:
            move = close - closes[i - 1]
            gains.append(move if move > 0 else 0.0)
            losses.append(-move if move < 0 else 0.0)
        if i == 14:
            gain, loss = sum(gains) / 14, sum(losses) / 14
        if i >= 14:
            gain, loss = (gain * 13 + gains[-1]) / 14, (loss * 13 + losses[-1]) / 14
        out.append((average[9], average[21], before[9], before[21], 50.0 if i < 14 else 100.0 - 100.0 / (1.0 + (100.0 if loss == 0 else gain / loss))))
    return out


def same(a, b):
    return a is None if b is None else math.isnan(a) if math.isnan(b) else abs(a - b) < 1e-9


@pytest.fixture(scope="module")
def histories(spark):
    rng, series = random.Random(3), {}
    for name, n in (("A", 1), ("B", 2), ("C", 14), ("D", 15), ("E", 16), ("F", 32), (None, 1200), ("H", 5000)):
        price, closes = 100.0, []
        for _ in range(n):
            price = max(0.5, price + rng.choice([-1, 1, 0, 0.5]) * rng.random())
            closes.append(price)
        series[name] = closes
    series["nan"] = [*series[None][:700], float("nan"), *series[None][701:]]
    series["rise"] = [3.0, 2.0, *(2.0 + 0.01 * i for i in range(12_000))]  # losses decay below what a double holds
    series["flat"] = [0.0] * 50
    rows = [(name, "1m", START + timedelta(minutes=i), c, c, c, None if math.isnan(c) else c, 1.0) for name, closes in series.items() for i, c in enumerate(closes)]
    rng.shuffle(rows)
    return series, spark.createDataFrame(rows, BAR).cache()


@pytest.mark.parametrize("chunk", [16, 100, 4096])
def test_full_history_is_the_loop(histories, chunk):
    series, bars = histories
    found = {}
    for r in full_history(bars, chunk).collect():
        found.setdefault(r["symbol"], []).append(r)
    assert set(found) == set(series)
    for name, closes in series.items():
        rows = sorted(found[name], key=lambda r: r["time"])
        assert [r["n_bars"] for r in rows] == list(range(1, len(closes) + 1))
        for r, want in zip(rows, looped(closes)):
            assert all(map(same, (r["ema9"], r["ema21"], r["prev_ema9"], r["prev_ema21"], r["rsi"]), want)), (name, r, want)


def test_full_history_of_nothing(histories):
    assert full_history(histories[1].limit(0)).count() == 0
    with pytest.raises(ValueError):
        full_history(histories[1], 14)


@pytest.fixture(scope="module")
def trades():
    """Bars with gaps, repeated times and bad prices, and signals at all sorts of distances."""
    rng, bars, signals = random.Random(4), [], []
    for name, n in (("A", 1500), ("B", 40), (None, 300)):
        price = 100.0
        for i in range(n):
            at = START + timedelta(minutes=i)
            if rng.random() < 0.05:
                continue
            price += rng.gauss(0, 1)
            low, high = price - rng.random(), price + rng.random()
            bars.append((name, "1m", at, price, float("nan") if rng.random() < 0.02 else high, None if rng.random() < 0.02 else low, price, 1.0))
            if rng.random() < 0.02:
                bars.append((name, "1m", at, price, price + 5, price - 5, price, 1.0))
            if rng.random() < 0.3:
                direction, wide = rng.choice(["BUY", "SELL", "NONE"]), rng.choice([0.5, 3, 20, 60, 1e6])
                stop, take = (price - wide, price + 1.5 * wide) if direction == "BUY" else (price + wide, price - 1.5 * wide)
                signals.append((name, "1m", at, direction, price, float("nan") if rng.random() < 0.05 else stop, take, i))
    return bars, [*signals, ("A", "1m", None, "BUY", 1.0, 0.0, 2.0, 0), signals[0], signals[1], ("none", "1m", START, "BUY", 1.0, 0.0, 2.0, 0)]


def touched(signal, bars):
    name, interval, at, direction, entry, stop, take, _ = signal
    known = lambda *x: all(v is not None and not math.isnan(v) for v in x)
    below, above = (lambda b, p: known(b[5], p) and b[5] <= p), (lambda b, p: known(b[4], p) and b[4] >= p)
    later = {}
    for b in bars:
        if at is not None and b[0] == name and b[2] > at:
            later.setdefault(b[2], []).append(b)
    for time in sorted(later):
        stopped = any((below if direction == "BUY" else above)(b, stop) for b in later[time])
        if stopped or any((above if direction == "BUY" else below)(b, take) for b in later[time]):
            price = stop if stopped else take
            return *signal[:7], "stop" if stopped else "take", time, price, price - entry if direction == "BUY" else entry - price
    return *signal[:7], "open", None, None, None


@pytest.mark.parametrize("width, searches", [(4096, 4096), (16, 3)])
def test_first_touches(spark, trades, monkeypatch, width, searches):
    monkeypatch.setattr(outcomes, "WIDTH", width)
    monkeypatch.setattr(outcomes, "SIGNALS", searches)
    bars, signals = trades
    given = spark.createDataFrame(signals, "symbol string, interval string, time timestamp_ntz, direction string, entry double, stop double, take double, gain long")
    found = first_touches(given, spark.createDataFrame(bars, BAR))
    assert found.columns == ["symbol", "interval", "time", "direction", "entry", "stop", "take", "exit", "exit_time", "exit_price", "gain"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(repr(touched(s, bars)) for s in signals if s[3] != "NONE")
    assert first_touches(given.limit(0), spark.createDataFrame(bars, BAR)).count() == 0


def test_bars_merge_in_any_order(spark):
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_id", "value")
    rows = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    halves = [partial_bars(ticks.where(f"event_id % 3 {sign} 1"), "5m") for sign in ("=", "<>")]
    whole = partial_bars(ticks, "5m")
    assert rows(merge_bars(halves[0].unionByName(halves[1]))) == rows(whole)
    assert rows(merge_bars(merge_bars(halves[1]).unionByName(halves[0]), "1h")) == rows(partial_bars(ticks, "1h"))
    together = every_interval(ticks, ["1m", "5m", "1h"])
    for interval in ("1m", "5m", "1h"):
        assert rows(together.where(f"interval = '{interval}'")) == rows(from_ticks(ticks, interval))


def test_newest_versions(spark):
    bar = lambda close, seq, minute=0: ("A", "1m", START + timedelta(minutes=minute), 1.0, 2.0, 1.0, close, 1.0, seq)
    rows = spark.createDataFrame([bar(1.8, 1), bar(1.5, 2), bar(1.9, None), bar(3.0, None, 1), bar(4.0, None, 1)], f"{BAR}, seq long")
    assert sorted(r["close"] for r in newest_versions(rows).collect()) == [1.5, 4.0]
    assert sorted(r["close"] for r in newest_versions(rows.drop("seq")).collect()) == [1.9, 4.0]


@pytest.mark.parametrize("bucket, within", [(86_400, None), (600, None), (7, 500), (600, 90)])
def test_as_of(spark, bucket, within):
    rng = random.Random(5)
    at = lambda s: START + timedelta(seconds=s)
    names = ["A", "B", None, "left only"]
    left = [(rng.choice(names), at(rng.randint(-500, 5000)) if rng.random() < 0.97 else None, i, "clash") for i in range(400)] + [("A", at(50), 1, "clash")] * 2
    right = [(rng.choice([*names[:3], "right only"]), at(rng.randint(0, 4000) // 10 * 10) if rng.random() < 0.97 else None, rng.choice([None, 1, 2, 3]), rng.choice([None, 1.5, float("nan"), 2.5])) for _ in range(300)]
    found = as_of(
        spark.createDataFrame(left, "k string, time timestamp_ntz, place int, side string"), spark.createDataFrame(right, "k string, ts timestamp_ntz, seq int, x double"),
        ["k"], "time", "ts", {"ts": "seen_at", "x": "seen", "seq": "seq"}, "seq", bucket, within,
    )

    def slow(k, time, *rest):
        low = lambda v: (v is not None, v if v == v else float("inf")) if v is not None else (False, 0)
        fit = [r for r in right if r[0] == k and time is not None and r[1] is not None and r[1] <= time]
        best = max(fit, key=lambda r: (r[1], low(r[2]), low(r[3])), default=None)
        if best is None or within is not None and (time - best[1]).total_seconds() > within:
            return k, time, *rest, None, None, None
        return k, time, *rest, best[1], best[3], best[2]

    assert found.columns == ["k", "time", "place", "side", "seen_at", "seen", "seq"]
    assert sorted(repr(tuple(r)) for r in found.collect()) == sorted(repr(slow(*r)) for r in left)
