import math
import random
from datetime import datetime, timedelta

import pytest

from emberline.operators.candles import BAR
from emberline.operators.sketches import bin_of, merged, quantile_spikes, quantiles, sketched, value_of

SERIES = "symbol string, interval string"
ODD = [None, math.nan, math.inf, -math.inf]


def exact(values, probability):
    known = sorted(v for v in values if v is not None and math.isfinite(v))
    return known[math.floor(probability * (len(known) - 1))] if known else None


def close(found, want, alpha):
    return abs(found - want) <= alpha * abs(want) * (1 + 1e-9)


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    found = [(k, rng.choice([rng.gauss(0, 50), rng.lognormvariate(0, 6), 0.0, float(rng.randint(-9, 9))])) for k in ("a", "b", None) for _ in range(400)]
    return [*found, *(("a", v) for v in ODD), *(("only odd", v) for v in ODD), ("one", -3.0), ("tiny", 5e-324), ("huge", 1.7e308)]


@pytest.mark.parametrize("alpha", [0.001, 0.01, 0.2])
@pytest.mark.parametrize("probability", [0.0, 0.37, 0.95, 1.0])
def test_quantiles_are_within_alpha_of_the_exact_ones(spark, values, alpha, probability):
    frame = spark.createDataFrame(values, "k string, v double")
    found = {r["k"]: r for r in quantiles(sketched(frame, ["k"], "v", alpha), ["k"], probability, alpha).collect()}
    assert set(found) == {"a", "b", None, "one", "tiny", "huge"}
    for k, row in found.items():
        own = [v for x, v in values if x == k]
        want = exact(own, probability)
        assert row["n_values"] == sum(v is not None and math.isfinite(v) for v in own)
        assert close(row["quantile"], want, alpha) or abs(want) < 1e-300, (k, row, want)


def test_parts_merge_in_any_order_to_the_sketch_of_the_whole(spark, values):
    frame = spark.createDataFrame([(k, i % 7, v) for i, (k, v) in enumerate(values)], "k string, part int, v double")
    parts = sketched(frame, ["k", "part"], "v")
    twice = merged(merged(parts.where("part < 3"), ["k"]).unionByName(merged(parts.where("part >= 3"), ["k"])), ["k"])
    want = sorted(map(repr, sketched(frame, ["k"], "v").collect()))
    assert want == sorted(map(repr, merged(parts, ["k"]).collect())) == sorted(map(repr, twice.collect()))


def test_bins_never_fall_as_values_rise(spark, values):
    frame = spark.createDataFrame([(v,) for _, v in values if v is not None and math.isfinite(v)], "v double")
    rows = sorted(frame.select("v", bin_of(frame.v).alias("bin"), value_of(bin_of(frame.v)).alias("back")).collect())
    assert all(a["bin"] <= b["bin"] for a, b in zip(rows, rows[1:]))
    assert all((r["back"] > 0) == (r["v"] > 0) and (r["back"] < 0) == (r["v"] < 0) for r in rows if abs(r["v"]) > 1e-300)


@pytest.mark.parametrize("days, probability, alpha", [(1, 0.9, 0.01), (3, 0.95, 0.05)])
def test_spikes_against_a_plain_loop(spark, days, probability, alpha):
    rng, start, rows = random.Random(9), datetime(2024, 2, 26), []
    for name in ("A", None):
        for i in range(300):
            at = start + timedelta(hours=i + 60 * (i > 150))
            rows.append((name, "1h", at, 1.0, 1.0, 1.0, 1.0, rng.choice([float(rng.randint(0, 40)), rng.expovariate(0.1), -2.0])))
    rows += [("A", "1h", None, 1.0, 1.0, 1.0, 1.0, 9e9), *(("A", "1h", start + timedelta(days=2, minutes=1 + i), 1.0, 1.0, 1.0, 1.0, v) for i, v in enumerate(ODD))]
    rows += [rows[100]] * 2  # repeated rows stay
    gamma = (1 + alpha) / (1 - alpha)
    found = quantile_spikes(spark.createDataFrame(rows, BAR), "volume", days, probability, alpha).collect()
    assert sorted(map(repr, (tuple(r)[:8] for r in found))) == sorted(map(repr, rows))
    assert {r["spike"] for r in found} == {True, False}
    for r in found:
        if r["time"] is None:
            assert (r["baseline"], r["n_values"], r["spike"]) == (None, None, False)
            continue
        before = [x[7] for x in rows if x[0] == r["symbol"] and x[2] is not None and 1 <= (r["time"].date() - x[2].date()).days <= days]
        want = exact(before, probability)
        if want is None:
            assert (r["baseline"], r["n_values"], r["spike"]) == (None, None, False)
            continue
        assert close(r["baseline"], want, alpha)
        assert r["n_values"] == sum(v is not None and math.isfinite(v) for v in before)
        volume = r["volume"]
        if volume is None or not math.isfinite(volume):
            assert not r["spike"]
        elif r["spike"]:
            assert volume > want
        else:
            assert volume <= max(want * gamma, want / gamma) * (1 + 1e-9)


def test_empty_tables_and_wrong_parameters(spark):
    empty = spark.createDataFrame([], BAR)
    assert quantile_spikes(empty).count() == 0 and sketched(empty, ["symbol"], "volume").count() == 0
    with pytest.raises(ValueError):
        sketched(empty, ["symbol"], "volume", 1.0)
    with pytest.raises(ValueError):
        quantiles(empty, ["symbol"], 1.5)
