"""A plain loop over one snapshot, written from the survey's definitions."""

from __future__ import annotations


def ema(prices, period):
    k = 2 / (period + 1)
    out = prices[:1]
    for x in prices[1:]:
        out = [*out, x * k + out[-1] * (1 - k)]
    return out


def rsi(prices, period=14):
    moves = [b - a for a, b in zip(prices, prices[1:])]
    gain = [m if m > 0 else 0.0 for m in moves]
    loss = [-m if m < 0 else 0.0 for m in moves]
    g = l = 0.0  # noqa: E741
    for x, y in zip(gain[:period], loss[:period]):
        g, l = g + x, l + y  # noqa: E741
    g, l, out = g / period, l / period, [50.0]  # noqa: E741
    for i in range(period, len(prices)):
        g, l = (g * (period - 1) + gain[i - 1]) / period, (l * (period - 1) + loss[i - 1]) / period  # noqa: E741
        out.append(100 - 100 / (1 + (100 if l == 0 else g / l)))
    return out


def atr(bars, period=14):
    if len(bars) < period:
        return 100.0
    total = 0.0
    for before, bar in list(zip(bars, bars[1:]))[:period]:
        ranges = [bar["high"] - bar["low"], abs(bar["high"] - before["close"]), abs(bar["low"] - before["close"])]
        total += float("nan") if any(r != r for r in ranges) else max(ranges)
    return total / period


def signal(bars):
    """The signal at the last bar of a snapshot."""
    closes = [b["close"] for b in bars]
    e9, e21 = ema(closes, 9), ema(closes, 21)
    mean = 0.0
    for b in bars[-20:]:
        mean += b["volume"]
    mean /= 20
    last, strength, reach = bars[-1], rsi(closes)[-1], atr(bars)
    spike = last["volume"] > mean * 2
    up = len(bars) > 1 and e9[-2] <= e21[-2] and e9[-1] > e21[-1] and strength < 70 and spike
    down = len(bars) > 1 and e9[-2] >= e21[-2] and e9[-1] < e21[-1] and strength > 30 and spike
    c = last["close"]
    direction, entry, stop, take = ("BUY", c, c - reach, c + 1.5 * reach) if up else ("SELL", c, c + reach, c - 1.5 * reach) if down else ("NONE", None, None, None)
    return {"direction": direction, "entry": entry, "stop": stop, "take": take, "atr": reach, "ema9": e9[-1], "ema21": e21[-1], "rsi": strength, "avg_vol": mean, "vol_spike": spike, "n_bars": len(bars)}


def history(bars, size=300):
    return [signal(bars[max(0, i + 1 - size) : i + 1]) for i in range(len(bars))]
