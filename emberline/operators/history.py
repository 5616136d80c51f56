"""Averages and strength index over the whole history of a series, not begun anew at each snapshot.

A chunk of bars takes the state it is entered with to keep * state + add, whatever that state is. So a first pass makes each chunk's (keep, add), a scan
over chunks and over groups of chunks gives every chunk the state it is entered with, and a second pass makes the bars' values. No task holds
a series: the widest one holds a row for every CHUNK ** 2 bars of it.

Values are those of a plain loop up to rounding (tests hold them within 1e-9); a NaN price makes all later averages NaN, and counts as no move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernel import EMA_PERIODS, PERIOD
from ..staging import staged
from .candles import KEY
from .snapshots import CHUNK, in_chunks

_HISTORY = "symbol string, interval string, time timestamp_ntz, close double, ema9 double, ema21 double, prev_ema9 double, prev_ema21 double, rsi double, n_bars long"
_MAP = "symbol string, interval string, chunk long, keep array<double>, add array<double>"
_STATE = "symbol string, interval string, chunk long, state array<double>"
#: What a bar's state decays by: both averages, then gains and losses.
_KEEP = np.array([1.0 - 2.0 / (period + 1) for period in EMA_PERIODS] + [(PERIOD - 1) / PERIOD] * 2)
#: A state above 0 decays to this at last and not to 0, as in the loop.
_TINY = np.nextafter(0.0, 1.0)


def _applied(keep: np.ndarray, add: np.ndarray, state: np.ndarray) -> np.ndarray:
    made = keep * state + add
    return np.where((made == 0) & (state > 0), _TINY, made)


def _running(keep: float, terms: np.ndarray, state: float) -> np.ndarray:
    """The states after each term, state = keep * state + term, by doubling steps."""
    made, step, factor = terms.copy(), 1, keep
    if len(made):
        made[0] += keep * state
    positive = np.logical_or.accumulate(np.append(state > 0, terms > 0))[1:]
    while step < len(made):
        made[step:] = made[step:] + factor * made[:-step]
        step, factor = 2 * step, max(factor * factor, _TINY)
    return np.where((made == 0) & positive, _TINY, made)


def _states(close: np.ndarray, before: float | None, state: np.ndarray) -> np.ndarray:
    """The four states after each bar. `before` is the close before the first bar, None at a series' start, where `state` means nothing."""
    out = np.full((4, len(close)), np.nan)
    with np.errstate(invalid="ignore", over="ignore", under="ignore"):
        for row, period in enumerate(EMA_PERIODS):
            k = 2.0 / (period + 1)
            terms = close * k
            if before is None:
                out[row] = np.concatenate([close[:1], _running(_KEEP[row], terms[1:], close[0])])
            else:
                out[row] = _running(_KEEP[row], terms, state[row])
        move = np.diff(close, prepend=np.nan if before is None else before)
        for row, part in ((2, move), (3, -move)):
            part = np.where(part > 0, part, 0.0)
            if before is not None:
                out[row] = _running(_KEEP[row], part / PERIOD, state[row])
            elif len(close) > PERIOD:  # the last of the moves that make the seed counts again
                seed = float(np.cumsum(part[1 : PERIOD + 1])[-1]) / PERIOD
                out[row, PERIOD:] = _running(_KEEP[row], part[PERIOD:] / PERIOD, seed)
    return out


def _chunk(table: pa.Table) -> tuple[pa.Table, np.ndarray, float | None, int]:
    """A chunk's own bars in order, their closes, the close before them, and the number of bars before them."""
    table = table.sort_by("bar_no")
    lead = table.num_rows - int(np.count_nonzero(table["home"].to_numpy()))
    close = table["close"].to_numpy()
    return table.slice(lead), close[lead:], float(close[0]) if lead else None, int(table["bar_no"][-1].as_py()) + 1 + lead - table.num_rows


def _as_map(table: pa.Table) -> pa.Table:
    own, close, before, _ = _chunk(table)
    if not len(close):  # the lead-in of a chunk that the series doesn't reach
        return _rows(own, keep=[], add=[])
    add = _states(close, before, np.zeros(4))[:, -1]
    keep = np.zeros(4) if before is None else np.maximum(_KEEP ** len(close), _TINY)
    return _rows(own.slice(0, 1), keep=[keep], add=[add])


def _rows(table: pa.Table, **columns: list[np.ndarray]) -> pa.Table:
    made = {name: pa.array([v.tolist() for v in values], pa.list_(pa.float64())) for name, values in columns.items()}
    return pa.table({**{c: table[c] for c in ("symbol", "interval", "chunk")}, **made})


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(-1, 4)


def _composed(table: pa.Table) -> pa.Table:
    """One map for a group of chunks, under the group's number."""
    table = table.sort_by("chunk")
    keep, add = np.ones(4), np.zeros(4)
    with np.errstate(invalid="ignore", over="ignore", under="ignore"):
        for k, a in zip(_vectors(table["keep"]), _vectors(table["add"])):
            keep, add = np.where(k == 0, 0.0, np.maximum(k * keep, _TINY)), np.where(k == 0, a, _applied(k, a, add))
    return _rows(table.slice(0, 1).drop_columns("chunk").rename_columns({"group": "chunk"}), keep=[keep], add=[add])


def _entered(table: pa.Table, states: pa.Table | None = None) -> pa.Table:
    """The state that each chunk of a group is entered with; the group itself with the one in `states`, or a series at its start."""
    table = table.sort_by("chunk")
    state = _vectors(states["state"])[0] if states is not None and states.num_rows else np.zeros(4)
    found = []
    with np.errstate(invalid="ignore", over="ignore", under="ignore"):
        for keep, add in zip(_vectors(table["keep"]), _vectors(table["add"])):
            found.append(state)
            state = np.where(keep == 0, add, _applied(keep, add, state))
    return _rows(table, state=found)


def _valued(table: pa.Table, states: pa.Table) -> pa.Table:
    own, close, before, first = _chunk(table)
    state = _vectors(states["state"])[0] if len(close) else np.zeros(4)
    made = _states(close, before, state)
    n = first + 1 + np.arange(len(close))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        ratio = np.where(made[3] == 0, 100.0, made[2] / np.where(made[3] == 0, 1.0, made[3]))
    rsi = np.where(n > PERIOD, 100.0 - 100.0 / (1.0 + ratio), 50.0)
    columns = {c: own[c] for c in ("symbol", "interval", "time", "close")}
    columns |= {f"ema{period}": pa.array(made[row]) for row, period in enumerate(EMA_PERIODS)}
    for row, period in enumerate(EMA_PERIODS):
        previous = np.concatenate([[np.nan if before is None else state[row]], made[row]])[: len(close)]
        columns[f"prev_ema{period}"] = pa.array(previous, mask=n == 1)
    return pa.table(columns | {"rsi": pa.array(rsi), "n_bars": pa.array(n)})


def full_history(bars: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per bar ema9, ema21, prev_ema9, prev_ema21 and rsi from all bars of its series up to it, and n_bars, their number.

    The previous averages are null for a first bar, rsi is 50 for the first 14. Null prices are NaN; bars of equal times are ordered by
    their values; an empty table gives no rows. The chunks and their maps are written to the shared folder, so the bars are made and numbered once.
    """
    if chunk <= PERIOD:
        raise ValueError("a chunk must hold the bars that make a first state")
    own = staged(in_chunks(bars, 1, chunk).select(*KEY, "time", "close", "bar_no", F.col("chunk").cast("long").alias("chunk"), "home"), "bars-in-chunks")
    maps = staged(own.groupBy(*KEY, "chunk").applyInArrow(_as_map, _MAP), "chunk-maps").withColumn("group", F.floor(F.col("chunk") / chunk))
    groups = maps.groupBy(*KEY, "group").applyInArrow(_composed, _MAP)
    entered = groups.groupBy(*KEY).applyInArrow(lambda t: _entered(t), _STATE).withColumnRenamed("chunk", "group")
    states = maps.groupBy(*KEY, "group").cogroup(entered.groupBy(*KEY, "group")).applyInArrow(lambda t, s: _entered(t, s), _STATE)
    return own.groupBy(*KEY, "chunk").cogroup(states.groupBy(*KEY, "chunk")).applyInArrow(_valued, _HISTORY)
