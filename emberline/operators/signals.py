"""Indicators and signals for every bar, or the last of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernel import SNAPSHOT
from .candles import newest
from .snapshots import last_indicators, with_indicators

#: Signal columns, in order.
SIGNAL = ["symbol", "interval", "time", "direction", "entry", "stop", "take", "rr", "atr", "ema9", "ema21", "rsi", "avg_vol", "vol_spike", "n_bars"]


def _number(*values: Column) -> Column:
    """Whether none is null or NaN: comparisons with those hold nowhere."""
    ok = F.lit(True)
    for v in values:
        ok = ok & v.isNotNull() & ~F.isnan(v)
    return ok


def spike(volume: Column, mean: Column) -> Column:
    return F.coalesce(_number(volume, mean) & (volume > mean * F.lit(2.0)), F.lit(False))


def cross_up() -> Column:
    names = [F.col(c) for c in ("prev_ema9", "prev_ema21", "ema9", "ema21")]
    return F.coalesce(_number(*names) & (names[0] <= names[1]) & (names[2] > names[3]), F.lit(False))


def cross_down() -> Column:
    names = [F.col(c) for c in ("prev_ema9", "prev_ema21", "ema9", "ema21")]
    return F.coalesce(_number(*names) & (names[0] >= names[1]) & (names[2] < names[3]), F.lit(False))


def signals(bars: DataFrame) -> DataFrame:
    """The signal at every bar: BUY, SELL or NONE with entry, stop and take."""
    return judge(with_indicators(bars))


def judge(indicated: DataFrame) -> DataFrame:
    """The signals of bars with their indicators."""
    indicated = indicated.withColumn("vol_spike", spike(F.col("volume"), F.col("avg_vol")))
    rsi, close, atr, wide = F.col("rsi"), F.col("close"), F.col("atr"), F.lit(1.5) * F.col("atr")
    buy = cross_up() & _number(rsi) & (rsi < 70) & F.col("vol_spike")
    sell = cross_down() & _number(rsi) & (rsi > 30) & F.col("vol_spike")
    judged = indicated.withColumn("direction", F.when(buy, "BUY").when(sell, "SELL").otherwise("NONE"))
    is_buy, is_sell = F.col("direction") == "BUY", F.col("direction") == "SELL"
    priced = judged.withColumns({
        "entry": F.when(is_buy | is_sell, close),
        "stop": F.when(is_buy, close - atr).when(is_sell, close + atr),
        "take": F.when(is_buy, close + wide).when(is_sell, close - wide),
    })
    shown = _number(F.col("entry")) & (F.col("entry") != 0)
    return priced.withColumn("rr", F.when(shown, "1:1.5").otherwise("-")).select(*SIGNAL)


def latest_signals(bars: DataFrame) -> DataFrame:
    """The signal at the last bar of each series, from its newest snapshot only."""
    return judge(last_indicators(newest(bars, SNAPSHOT)))
