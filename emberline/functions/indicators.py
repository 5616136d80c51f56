"""Indicators as Column expressions over arrays of doubles, oldest first.

Each follows its recurrence from the array's first element in left-to-right order, so results equal a
plain loop's bit for bit. Missing prices are NaN, never null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _double(value: float) -> Column:
    return F.lit(float(value))


def positive_part(x: Column) -> Column:
    """x where it is above 0, else 0; also 0 for NaN."""
    return F.when(~F.isnan(x) & (x > 0), x).otherwise(_double(0))


def negative_part(x: Column) -> Column:
    """-x where x is below 0, else 0; also 0 for NaN."""
    return F.when(~F.isnan(x) & (x < 0), -x).otherwise(_double(0))


def _without_first(values: Column) -> Column:
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))


def ema(prices: Column, period: int) -> Column:
    """struct(prev, cur): the last two values of the exponential moving average seeded with the first price; prev is null for one price.

    The fold carries one double; the last step is taken outside it.
    """
    k, rest = F.lit(2.0) / _double(period + 1), F.lit(1.0) - F.lit(2.0) / _double(period + 1)
    size, first = F.size(prices), F.get(prices, F.lit(0))
    inner = F.slice(prices, F.lit(2), F.greatest(size - 2, F.lit(0)))
    prev = F.when(size > 1, F.aggregate(inner, first, lambda a, x: x * k + a * rest))
    return F.transform(F.array(prev), lambda p: F.struct(p.alias("prev"), F.coalesce(F.get(prices, size - 1) * k + p * rest, first).alias("cur")))[0]


def ema_series(prices: Column, period: int) -> Column:
    """The average at every price, as an array of the same length. Meant for one snapshot: it copies as it grows."""
    k = F.lit(2.0) / _double(period + 1)
    start = F.slice(prices, F.lit(1), F.lit(1))
    return F.aggregate(_without_first(prices), start, lambda a, x: F.concat(a, F.array(x * k + F.element_at(a, -1) * (F.lit(1.0) - k))))


def changes(prices: Column) -> Column:
    """Each price less the one before; one element fewer."""
    return F.transform(_without_first(prices), lambda x, i: x - F.get(prices, i))


def _strength(gain: Column, loss: Column) -> Column:
    ratio = F.when(loss == 0, _double(100)).otherwise(gain / F.when(loss != 0, loss))
    return _double(100) - _double(100) / (_double(1) + ratio)


def _sum(values: Column) -> Column:
    return F.aggregate(values, _double(0), lambda a, x: a + x)


def rsi_series(prices: Column, period: int = 14) -> Column:
    """50, then one value for each price from number `period` (counted from 0) on; only [50] for fewer prices.

    The first smoothing step repeats the seed's last change, and a loss of 0 counts as a ratio of 100.
    """
    moves = changes(prices)
    seed = F.struct(
        (_sum(F.transform(F.slice(moves, 1, period), positive_part)) / _double(period)).alias("g"),
        (_sum(F.transform(F.slice(moves, 1, period), negative_part)) / _double(period)).alias("l"),
        F.array(_double(50)).alias("out"),
    )

    def step(a: Column, x: Column) -> Column:
        g, l = _smoothed(a, x, period)  # noqa: E741
        return F.struct(g.alias("g"), l.alias("l"), F.concat(a["out"], F.array(_strength(g, l))).alias("out"))

    return F.when(F.size(moves) < period, F.array(_double(50))).otherwise(F.aggregate(_from(moves, period), seed, step, lambda a: a["out"]))


def _from(moves: Column, period: int) -> Column:
    return F.slice(moves, F.lit(period), F.greatest(F.size(moves) - (period - 1), F.lit(0)))


def _smoothed(a: Column, x: Column, period: int) -> tuple[Column, Column]:
    return (
        (a["g"] * _double(period - 1) + positive_part(x)) / _double(period),
        (a["l"] * _double(period - 1) + negative_part(x)) / _double(period),
    )


def rsi(prices: Column, period: int = 14) -> Column:
    """The last value of rsi_series, without building it."""
    moves = changes(prices)
    return rsi_of_moves(F.transform(moves, positive_part), F.transform(moves, negative_part), period)


def rsi_of_moves(gains: Column, losses: Column, period: int = 14) -> Column:
    """The last value of rsi_series from the moves' positive and negative parts."""

    def smoothed(parts: Column) -> Column:
        seed = _sum(F.slice(parts, 1, period)) / _double(period)
        return F.aggregate(_from(parts, period), seed, lambda a, x: (a * _double(period - 1) + x) / _double(period))

    return F.when(F.size(gains) < period, _double(50)).otherwise(_strength(smoothed(gains), smoothed(losses)))


def true_range(high: Column, low: Column, previous_close: Column) -> Column:
    """The widest of high - low and the two distances to the previous close; null without one, NaN if any price is."""
    widest = F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))
    return F.when(previous_close.isNotNull(), widest)


def atr(ranges: Column, period: int = 14) -> Column:
    """Mean of the ranges at 1 to `period`, the oldest of the snapshot; always divided by `period`; 100 for fewer bars than that."""
    return F.when(F.size(ranges) >= period, _sum(F.slice(ranges, 2, period)) / _double(period)).otherwise(_double(100))
