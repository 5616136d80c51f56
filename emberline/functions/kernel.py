"""All indicators of a run of bars at once, as numpy steps over every bar's snapshot.

Step t takes element t of all snapshots together, in the order of the plain loop, so results are the
loop's bit for bit, and a run of n bars costs `size` vector steps and not n * size interpreted ones.
"""

from __future__ import annotations

import numpy as np

SNAPSHOT = 300
EMA_PERIODS, PERIOD, VOLUMES = (9, 21), 14, 20


def _average(close: np.ndarray, starts: np.ndarray, counts: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """The last two values of each snapshot's average, NaN for a missing one. Counts don't fall from bar to bar."""
    k = 2.0 / (period + 1)
    current, previous = close[starts], np.full(len(starts), np.nan)
    for t in range(1, int(counts.max(initial=0))):
        on = np.searchsorted(counts, t, "right")
        previous[on:] = current[on:]
        current[on:] = close[starts[on:] + t] * k + current[on:] * (1.0 - k)
    return current, previous


def _smoothed(parts: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each snapshot's smoothed gains or losses: the mean of the first PERIOD moves, then steps from the last of these on."""
    total = np.zeros(len(starts))
    for t in range(1, int(counts.max(initial=0))):
        on = np.searchsorted(counts, max(t, PERIOD), "right")  # only snapshots with PERIOD moves
        at = starts[on:] + t
        if t <= PERIOD:
            total[on:] = total[on:] + parts[at]
        if t == PERIOD:
            total[on:] = total[on:] / PERIOD
        if t >= PERIOD:
            total[on:] = (total[on:] * (PERIOD - 1) + parts[at]) / PERIOD
    return total


def indicators(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray, lead: int = 0, size: int = SNAPSHOT) -> dict[str, np.ndarray]:
    """The indicators of the bars from number `lead` on, each from the last `size` bars up to it.

    The bars are in order of time, with the size - 1 before bar `lead` if there are so many; missing values are
    NaN. prev_ema9 and prev_ema21 mean nothing where n_bars is 1.
    """
    last = np.arange(lead, len(close))
    starts = np.maximum(0, last - size + 1)
    counts = last - starts + 1
    out = {"n_bars": counts.astype(np.int32)}
    for period in EMA_PERIODS:
        out[f"ema{period}"], out[f"prev_ema{period}"] = _average(close, starts, counts, period)

    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        move = np.concatenate([[np.nan], close[1:] - close[:-1]])[: len(close)]
        gain, loss = (_smoothed(np.where(part > 0, part, 0.0), starts, counts) for part in (move, -move))
        ratio = np.where(loss == 0, 100.0, gain / np.where(loss == 0, 1.0, loss))
        out["rsi"] = np.where(counts > PERIOD, 100.0 - 100.0 / (1.0 + ratio), 50.0)

        before = np.concatenate([[np.nan], close[:-1]])[: len(close)]
        widest = np.maximum(np.maximum(high - low, np.abs(high - before)), np.abs(low - before))
        total, enough = np.zeros(len(last)), counts >= PERIOD
        for t in range(1, PERIOD + 1):
            on = enough & (counts > t)
            total[on] = total[on] + widest[starts[on] + t]
        out["atr"] = np.where(enough, total / PERIOD, 100.0)

        summed = np.zeros(len(last))
        for back in range(VOLUMES - 1, -1, -1):
            on = counts > back
            summed[on] = summed[on] + volume[last[on] - back]
        out["avg_vol"] = summed / 20.0
    return out
