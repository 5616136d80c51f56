"""Signals over a stream of bars, with the last bars of each series as state.

The state is a map in RocksDB, a bar by its time, so a batch writes the bars it changes and no others. A series that
stays silent can be given up by a timer.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.kernel import SNAPSHOT, indicators
from ..operators.candles import KEY, SEQUENCE, clean
from ..operators.signals import judge
from ..operators.snapshots import INDICATED

_COLUMNS = [x.split()[0] for x in INDICATED.split(", ")]
_VALUES = ["high", "low", "close", "volume"]
#: Bars of a series that are held at most: a snapshot for the oldest bar that may still change.
HELD = 2 * SNAPSHOT - 1
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Streams that start from now on in this session keep their state in RocksDB, as the map of bars needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


@contextmanager
def _on_path(spark: SparkSession) -> Iterator[None]:
    """Functions made meanwhile also look for this package where it lies on the driver: Spark reads a processor's state schema in a worker there, which knows no shipped files."""
    environment, own = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    before = environment.get("PYTHONPATH")
    environment["PYTHONPATH"] = own if before is None else f"{own}{os.pathsep}{before}"
    try:
        yield
    finally:
        if before is None:
            del environment["PYTHONPATH"]
        else:
            environment["PYTHONPATH"] = before


class TrailingBars(StatefulProcessor):
    """Per series the last bars and, for those that come or change and the ones after them, their indicators."""

    def __init__(self, idle_seconds: float | None):
        self.idle = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "time long", "seq long, high double, low double, close double, volume double")

    def _held(self) -> pd.DataFrame:
        rows = [(key[0], *value) for key, value in self.bars.iterator()]
        held = pd.DataFrame(rows, columns=["time", SEQUENCE, *_VALUES]).astype({"time": "int64", SEQUENCE: "int64"} | dict.fromkeys(_VALUES, "float64"))
        return held.sort_values("time", ignore_index=True)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self._held()
        held = before.assign(arrival=0)
        for batch in rows:
            came = batch.dropna(subset="time")
            came = came.assign(time=came["time"].astype("datetime64[us]").astype("int64"), arrival=1)[["time", SEQUENCE, *_VALUES, "arrival"]].astype(held.dtypes.to_dict())
            late = came["time"] < held["time"].iloc[-SNAPSHOT] if len(held) >= HELD else pd.Series(False, came.index)
            if late.any():
                old = came[late]
                yield self._sent(key, old, {"n_bars": np.zeros(len(old), np.int32)})
            # Of the versions of a bar the one with the largest number counts, of equal numbers the one of the later batch, of one batch the one with the larger values.
            merged = pd.concat([held, came[~late]]).sort_values(["time", SEQUENCE, "arrival", *_VALUES], kind="stable").drop_duplicates("time", keep="last").reset_index(drop=True)
            same = merged.merge(held, on=["time", *_VALUES], how="left", indicator=True)["_merge"] == "both"
            if not same.all():
                first = int(np.argmin(same.to_numpy()))
                found = indicators(*(merged[c].to_numpy() for c in _VALUES), lead=first)
                yield self._sent(key, merged.iloc[first:], found)
            held = merged.iloc[-HELD:].reset_index(drop=True)
        self._keep(before, held)
        if self.idle is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * self.idle))

    @staticmethod
    def _sent(key: tuple, bars: pd.DataFrame, found: dict[str, np.ndarray]) -> pd.DataFrame:
        own = {"symbol": key[0], "interval": key[1], "time": bars["time"].astype("datetime64[us]").to_numpy(), "close": bars["close"].to_numpy(), "volume": bars["volume"].to_numpy()}
        made = pd.DataFrame(own | found).reindex(columns=_COLUMNS)
        made.loc[made["n_bars"] == 1, ["prev_ema9", "prev_ema21"]] = None
        return made

    def _keep(self, before: pd.DataFrame, held: pd.DataFrame) -> None:
        """Writes the bars that changed, and removes those that are held no more."""
        known = dict(zip(before["time"], before[[SEQUENCE, *_VALUES]].itertuples(index=False, name=None)))
        for time, *value in held[["time", SEQUENCE, *_VALUES]].itertuples(index=False, name=None):
            if repr(known.pop(time, None)) != repr(tuple(value)):
                self.bars.updateValue((int(time),), (int(value[0]), *map(float, value[1:])))
        for time in known:
            self.bars.removeKey((int(time),))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.bars.clear()
        return iter([])

    def close(self) -> None:
        pass


def trailing_indicators(bars: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """The indicators of every new or changed bar of a stream, as the batch history gives them.

    The state of a series is its last HELD bars. A bar whose time is held replaces that one, so the
    still forming last bar may come again and again; a late bar takes its place. Either way the bar and those
    after it are sent anew: take the last row sent for each time. A bar that comes again unchanged
    sends nothing. Of several versions of a bar the one with the largest `seq` counts, if the bars have such a column (null: the least), else the
    one that came last, or of one batch the one with the larger values. A bar older than the SNAPSHOT newest can't be judged: it is sent with n_bars 0 and no
    indicators, and a bar of no time is left out.

    With `idle_seconds` a series is forgotten once no bar came for so long, and starts anew with its next bar; such a stream goes on making batches
    for its timers, so it doesn't end under an availableNow trigger. Sets the session's state store to RocksDB.
    """
    use_rocksdb(bars.sparkSession)
    numbered = clean(bars).withColumn(SEQUENCE, F.lit(0).cast("long")) if SEQUENCE not in bars.columns else clean(bars, SEQUENCE).withColumn(SEQUENCE, F.coalesce(F.col(SEQUENCE).cast("long"), F.lit(-(2**63))))
    with _on_path(bars.sparkSession):
        made = numbered.groupBy(*KEY).transformWithStateInPandas(TrailingBars(idle_seconds), INDICATED, "append", "none" if idle_seconds is None else "processingTime")
    # On its way from pandas a NaN becomes null.
    least = {c: 2 if c.startswith("prev") else 1 for c in _COLUMNS if c not in ("symbol", "interval", "time", "n_bars")}
    return made.withColumns({c: F.when((F.col("n_bars") >= n) & F.col(c).isNull(), float("nan")).otherwise(F.col(c)) for c, n in least.items()})


def stream_signals(bars: DataFrame, idle_seconds: float | None = None) -> DataFrame:
    """The signal at every bar of a stream, as the batch history gives it, and again for bars that later ones change.

    Spark runs no such state behind a streaming aggregate, so bars_of_stream goes to a table first and
    this reads the table as a stream.
    """
    return judge(trailing_indicators(bars, idle_seconds))
