"""Trailing snapshots: what a poll at each bar would have seen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernel import SNAPSHOT, indicators
from .candles import KEY, clean, numbered

#: Bars of a chunk that one task holds at once, besides its lead-in.
CHUNK = 4096

#: What the indicators of a bar are: the bar's own columns and its snapshot's values.
INDICATED = (
    "symbol string, interval string, time timestamp_ntz, close double, volume double, ema9 double, ema21 double, prev_ema9 double, prev_ema21 double,"
    " rsi double, atr double, avg_vol double, n_bars int"
)
_COLUMNS = [x.split()[0] for x in INDICATED.split(", ")]


def in_chunks(bars: DataFrame, lead: int, chunk: int = CHUNK) -> DataFrame:
    """The bars with bar_no and chunk, and `home` false on the copies of the `lead` bars before a chunk that it also gets.

    One long series is thus spread over many tasks, and each reads its own chunk only.
    """
    home = F.floor(F.col("bar_no") / chunk)
    own = F.struct(home.alias("chunk"), F.lit(True).alias("home"))
    also = F.when(F.col("bar_no") % chunk >= chunk - lead, F.struct((home + 1).alias("chunk"), F.lit(False).alias("home")))
    return numbered(bars).withColumn("copy", F.explode(F.array_compact(F.array(own, also)))).select("*", "copy.*").drop("copy")


def with_previous(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Bars with prev_close, the close of the bar before in the series."""
    order = Window.partitionBy(*KEY, "chunk").orderBy("bar_no")
    return in_chunks(bars, 1, chunk).withColumn("prev_close", F.lag("close").over(order)).where("home").drop("chunk", "home", "bar_no")


def _indicate(lead_in: str | None, size: int):
    """An Arrow function over one chunk: indicators of its home bars, or of the last bar only."""

    def indicate(table: pa.Table) -> pa.Table:
        table = table.sort_by("bar_no")
        high, low, close, volume = (table[c].to_numpy() for c in ("high", "low", "close", "volume"))
        lead = table.num_rows - 1 if lead_in is None else table.num_rows - int(np.count_nonzero(table[lead_in].to_numpy()))
        found = indicators(high, low, close, volume, lead, size)
        single = found["n_bars"] == 1
        columns = {c: table[c].slice(lead) for c in ("symbol", "interval", "time", "close", "volume")}
        columns |= {c: pa.array(v, mask=single if c.startswith("prev") else None) for c, v in found.items()}
        return pa.table([columns[c] for c in _COLUMNS], names=_COLUMNS)

    return indicate


def with_indicators(bars: DataFrame, size: int = SNAPSHOT, chunk: int = CHUNK) -> DataFrame:
    """Per bar its indicators, each from the last `size` bars of its series alone; prev_ema9 and prev_ema21 are null for a first bar."""
    if chunk < size:
        raise ValueError("a chunk must hold a snapshot")
    return in_chunks(bars, size - 1, chunk).groupBy(*KEY, "chunk").applyInArrow(_indicate("home", size), INDICATED)


def last_indicators(newest_bars: DataFrame, size: int = SNAPSHOT) -> DataFrame:
    """The indicators of the last bar of each series; the bars are a snapshot of each, `size` or so."""
    placed = clean(newest_bars).withColumn("bar_no", F.struct("time", "open", "high", "low", "close", "volume"))
    ranked = placed.withColumn("bar_no", F.row_number().over(Window.partitionBy(*KEY).orderBy("bar_no")))
    return ranked.groupBy(*KEY).applyInArrow(_indicate(None, size), INDICATED)
