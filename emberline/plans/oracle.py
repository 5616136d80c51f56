"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour"}
_KEYS = "symbol, interval, time"
#: Bins of quantile sketches with a relative error of 0.01.
_GAMMA = "(1.01::DOUBLE / 0.99::DOUBLE)"
_LOG = f"ln({_GAMMA})"
_BAR = f"{_KEYS}, open, high, low, close, volume"


def _bars(interval: str = "5m", symbol: str = "'ALL'") -> str:
    return f"""SELECT {symbol} AS symbol, '{interval}' AS interval, time_bucket(INTERVAL '{_BUCKETS[interval]}', ts) AS time,
        first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
        FROM events GROUP BY ALL"""


def _ema(closes: str, period: int) -> str:
    k = f"(2::DOUBLE / {period + 1}::DOUBLE)"
    return f"list_reduce({closes}[2:], lambda s, x: {{'p': s.c, 'c': x * {k} + s.c * (1::DOUBLE - {k})}}, {{'p': NULL::DOUBLE, 'c': {closes}[1]}})"


def _strength(closes: str) -> str:
    """The last strength index of a list of closes."""
    moves = f"list_transform(range(2, len({closes}) + 1), lambda i: {closes}[i] - {closes}[i - 1])"
    total = lambda part: f"list_reduce(list_transform(m[1:14], lambda x: greatest({part}, 0::DOUBLE)), lambda a, b: a + b, 0::DOUBLE) / 14"
    fold = (
        "list_reduce(m[14:], lambda s, x: {'g': (s.g * 13::DOUBLE + greatest(x, 0::DOUBLE)) / 14, 'l': (s.l * 13::DOUBLE + greatest(-x, 0::DOUBLE)) / 14},"
        f" {{'g': {total('x')}, 'l': {total('-x')}}})"
    )
    rs = "CASE WHEN f.l = 0 THEN 100::DOUBLE ELSE f.g / f.l END"
    return f"list_transform([{moves}], lambda m: CASE WHEN len(m) < 14 THEN 50::DOUBLE ELSE list_transform([{fold}], lambda f: 100::DOUBLE - 100::DOUBLE / (1::DOUBLE + {rs}))[1] END)[1]"


def _history(interval: str = "5m", symbol: str = "'ALL'") -> str:
    """Common table expressions up to `judged`: a row per bar with its snapshot's indicators and signal."""
    return f"""WITH bars AS ({_bars(interval, symbol)}),
    lagged AS (SELECT *, lag(close) OVER s AS prev_close FROM bars WINDOW s AS (PARTITION BY symbol, interval ORDER BY time)),
    ranged AS (SELECT *, CASE WHEN prev_close IS NOT NULL THEN greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END AS true_range FROM lagged),
    framed AS (SELECT *, list(close) OVER t AS closes, list(true_range) OVER t AS ranges, list(volume) OVER v AS volumes FROM ranged
        WINDOW t AS (PARTITION BY symbol, interval ORDER BY time ROWS BETWEEN 299 PRECEDING AND CURRENT ROW),
               v AS (PARTITION BY symbol, interval ORDER BY time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    folded AS (SELECT *, {_ema('closes', 9)} AS e9, {_ema('closes', 21)} AS e21, {_strength('closes')} AS rsi,
        CASE WHEN len(ranges) >= 14 THEN list_reduce(ranges[2:15], lambda a, b: a + b, 0::DOUBLE) / 14 ELSE 100::DOUBLE END AS atr,
        list_reduce(volumes, lambda a, b: a + b, 0::DOUBLE) / 20 AS avg_vol, len(closes)::INTEGER AS n_bars FROM framed),
    flagged AS (SELECT *, e9.c AS ema9, e21.c AS ema21, e9.p AS prev_ema9, e21.p AS prev_ema21, volume > avg_vol * 2 AS vol_spike,
        coalesce(e9.p <= e21.p AND e9.c > e21.c, false) AS cross_up, coalesce(e9.p >= e21.p AND e9.c < e21.c, false) AS cross_down FROM folded),
    directed AS (SELECT *, CASE WHEN cross_up AND rsi < 70 AND vol_spike THEN 'BUY' WHEN cross_down AND rsi > 30 AND vol_spike THEN 'SELL' ELSE 'NONE' END AS direction FROM flagged),
    judged AS (SELECT *, CASE WHEN direction <> 'NONE' THEN close END AS entry,
        CASE direction WHEN 'BUY' THEN close - atr WHEN 'SELL' THEN close + atr END AS stop,
        CASE direction WHEN 'BUY' THEN close + 1.5::DOUBLE * atr WHEN 'SELL' THEN close - 1.5::DOUBLE * atr END AS take,
        CASE WHEN direction <> 'NONE' AND close <> 0 THEN '1:1.5' ELSE '-' END AS rr FROM directed)
    """


_SIGNAL = f"{_KEYS}, direction, entry, stop, take, rr, atr, ema9, ema21, rsi, avg_vol, vol_spike, n_bars"
_BY_TYPE = "event_type"


def _newest(symbol: str = _BY_TYPE) -> str:
    return f"WITH bars AS ({_bars('5m', symbol)}), newest AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol, interval ORDER BY time DESC) <= 300)"


def _series(period: int) -> str:
    k = f"(2::DOUBLE / {period + 1}::DOUBLE)"
    return f"list_reduce(closes[2:], lambda s, x: list_append(s, x * {k} + s[-1] * (1::DOUBLE - {k})), [closes[1]])"


def _shown(value: str, digits: int = 2) -> str:
    """Fixed decimals, half up. Only odd multiples of a power of two lie exactly between two; those are nudged."""
    tie = 2 ** (digits + 1)
    nudge = f"CASE WHEN {value} * {tie} = floor({value} * {tie}) AND {value} * {tie // 2} <> floor({value} * {tie // 2}) THEN 0.001::DOUBLE ELSE 0::DOUBLE END"
    return f"printf('%.{digits}f', {value} + {nudge})"


def _latest() -> str:
    return f"{_history('5m', _BY_TYPE)} SELECT {_SIGNAL} FROM judged QUALIFY time = max(time) OVER (PARTITION BY symbol, interval)"


def _smooth(parts: str) -> str:
    """The smoothed gains or losses of a whole series, from its fifteenth bar on."""
    seed = f"(list_reduce({parts}[1:14], lambda a, b: a + b, 0::DOUBLE) / 14)"
    return f"list_reduce({parts}[15:], lambda s, x: list_append(s, (s[-1] * 13::DOUBLE + x) / 14), [({seed} * 13::DOUBLE + {parts}[14]) / 14])"


def oracle_sql() -> dict[str, str]:
    price = lambda c: f"CASE WHEN {c} IS NOT NULL AND {c} <> 0 THEN 'US$ ' || {_shown(c)} ELSE '-' END AS {c}"
    return {
        **{f"candles_{i}": _bars(i) for i in ("1m", "5m", "15m")},
        "series_of_interval": _bars("15m"),
        "last_300_bars": f"{_newest(chr(39) + 'ALL' + chr(39))} SELECT {_BAR} FROM newest",
        "closed_bars": f"WITH bars AS ({_bars('5m', _BY_TYPE)}) SELECT {_BAR} FROM bars QUALIFY time < max(time) OVER (PARTITION BY symbol, interval)",
        "klines_json_parse": _bars(),
        "klines_of_mixed_answers": f"SELECT * FROM ({_bars()}) WHERE day(time) % 5 = 0",
        "price_change": f"{_history()} SELECT {_KEYS}, close - prev_close AS change, coalesce(greatest(close - prev_close, 0::DOUBLE), 0) AS gain,"
        " CASE WHEN close < prev_close THEN prev_close - close ELSE 0::DOUBLE END AS loss FROM judged",
        "true_range": f"{_history()} SELECT {_KEYS}, true_range FROM judged",
        "ema_series": f"{_history()} SELECT {_KEYS}, ema9, ema21, prev_ema9, prev_ema21 FROM judged",
        "rsi_series": f"{_history()} SELECT {_KEYS}, rsi FROM judged",
        "atr_head": f"{_history()} SELECT {_KEYS}, atr FROM judged",
        "volume_mean_spike": f"{_history()} SELECT {_KEYS}, avg_vol, vol_spike FROM judged",
        "cross_flags": f"{_history()} SELECT {_KEYS}, cross_up, cross_down FROM judged",
        "signal_history": f"{_history()} SELECT {_SIGNAL} FROM judged",
        "signal_history_1m": f"{_history('1m')} SELECT {_SIGNAL} FROM judged",
        "signal_history_by_symbol": f"{_history('5m', _BY_TYPE)} SELECT {_SIGNAL} FROM judged",
        "signal_latest": _latest(),
        "chart_lines": f"""{_newest()}, folded AS (SELECT symbol, interval, list(time ORDER BY time) AS times, list(close ORDER BY time) AS closes FROM newest GROUP BY ALL)
            SELECT symbol, interval, unnest(times) AS time, unnest({_series(9)}) AS ema9, unnest({_series(21)}) AS ema21 FROM folded""",
        "rsi_snapshot": f"""{_newest()}, folded AS (SELECT symbol, interval, list(close ORDER BY time) AS closes FROM newest GROUP BY ALL),
            placed AS (SELECT symbol, interval, closes, unnest(range(0, greatest(1, len(closes) - 13))) AS i FROM folded)
            SELECT symbol, interval, i::INTEGER AS index, CASE WHEN i = 0 THEN 50::DOUBLE ELSE {_strength('closes[1:14 + i]')} END AS rsi FROM placed""",
        "price_lines": f"""{_history()}, fired AS (SELECT * FROM judged WHERE direction <> 'NONE')
            SELECT {_KEYS}, 'entry' AS line, entry AS price, 'dashed' AS style, 'Entry' AS title FROM fired
            UNION ALL SELECT {_KEYS}, 'stop', stop, 'dotted', 'Stop' FROM fired UNION ALL SELECT {_KEYS}, 'take', take, 'dotted', 'Take 1:1.5' FROM fired""",
        "markers": f"""{_history()} SELECT {_KEYS}, CASE direction WHEN 'BUY' THEN 'belowBar' ELSE 'aboveBar' END AS position,
            CASE direction WHEN 'BUY' THEN '#00ff88' ELSE '#ff4444' END AS color, CASE direction WHEN 'BUY' THEN 'arrowUp' ELSE 'arrowDown' END AS shape, direction AS text
            FROM judged WHERE direction <> 'NONE'""",
        "info_panel": f"""{_history()} SELECT {_KEYS}, direction, 'signal ' || CASE direction WHEN 'BUY' THEN 'buy' WHEN 'SELL' THEN 'sell' ELSE 'none' END AS css_class,
            {price('entry')}, {price('stop')}, {price('take')}, rr, 'US$ ' || {_shown('atr')} AS atr, 'US$ ' || {_shown('ema9')} AS ema9, 'US$ ' || {_shown('ema21')} AS ema21,
            {_shown('rsi', 1)} AS rsi, CASE WHEN vol_spike THEN '↑' ELSE '—' END AS vol FROM judged""",
        "every_interval": " UNION ALL ".join(_bars(i, _BY_TYPE) for i in _BUCKETS),
        "indicators_full_history": f"""WITH bars AS ({_bars('1m')}), listed AS (SELECT symbol, interval, list(time ORDER BY time) AS times, list(close ORDER BY time) AS closes FROM bars GROUP BY ALL),
            moved AS (SELECT *, list_transform(range(2, len(closes) + 1), lambda i: closes[i] - closes[i - 1]) AS moves FROM listed),
            parts AS (SELECT *, list_transform(moves, lambda m: greatest(m, 0::DOUBLE)) AS gains, list_transform(moves, lambda m: greatest(-m, 0::DOUBLE)) AS losses FROM moved),
            folded AS (SELECT *, {_series(9)} AS a, {_series(21)} AS b, {_smooth('gains')} AS g, {_smooth('losses')} AS l FROM parts),
            r AS (SELECT symbol, interval, unnest(times) AS time, unnest(a) AS ema9, unnest(b) AS ema21, unnest(range(1, len(times) + 1)) AS n_bars, g, l FROM folded)
            SELECT {_KEYS}, round(ema9, 6) AS ema9, round(ema21, 6) AS ema21, round(lag(ema9) OVER s, 6) AS prev_ema9, round(lag(ema21) OVER s, 6) AS prev_ema21,
                round(CASE WHEN n_bars < 15 THEN 50::DOUBLE ELSE 100::DOUBLE - 100::DOUBLE / (1::DOUBLE + CASE WHEN l[n_bars - 14] = 0 THEN 100::DOUBLE ELSE g[n_bars - 14] / l[n_bars - 14] END) END, 6) AS rsi,
                n_bars FROM r WINDOW s AS (PARTITION BY symbol, interval ORDER BY time)""",
        "signal_outcomes": f"""{_history('5m', _BY_TYPE)}, fired AS (SELECT * FROM judged WHERE direction <> 'NONE'),
            met AS (SELECT f.symbol, f.interval, f.time, b.time AS exit_time, CASE f.direction WHEN 'BUY' THEN b.low <= f.stop ELSE b.high >= f.stop END AS stopped
                FROM fired f JOIN bars b ON b.symbol = f.symbol AND b.interval = f.interval AND b.time > f.time
                AND CASE f.direction WHEN 'BUY' THEN b.low <= f.stop OR b.high >= f.take ELSE b.high >= f.stop OR b.low <= f.take END),
            firsts AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY symbol, interval, time ORDER BY exit_time) = 1),
            ended AS (SELECT f.*, exit_time, CASE WHEN exit_time IS NULL THEN 'open' WHEN stopped THEN 'stop' ELSE 'take' END AS exit FROM fired f LEFT JOIN firsts USING (symbol, interval, time)),
            priced AS (SELECT *, CASE exit WHEN 'stop' THEN stop WHEN 'take' THEN take END AS exit_price FROM ended)
            SELECT {_KEYS}, direction, entry, stop, take, exit, exit_time, exit_price, CASE direction WHEN 'BUY' THEN exit_price - entry ELSE entry - exit_price END AS gain FROM priced""",
        "signals_with_ticks": f"""{_history('5m', _BY_TYPE)}, ticks AS (SELECT event_type AS symbol, ts, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL)
            SELECT {_KEYS.replace('symbol', 'j.symbol')}, direction, CASE WHEN fresh THEN ts END AS tick_time, CASE WHEN fresh THEN event_id END AS tick_id, CASE WHEN fresh THEN value END AS tick_value
            FROM (SELECT j.*, t.ts, t.event_id, t.value, t.ts >= j.time - INTERVAL 1 HOUR AS fresh FROM judged j ASOF LEFT JOIN ticks t ON t.symbol = j.symbol AND t.ts <= j.time) j""",
        "indicators_by_sql": f"{_history('5m', _BY_TYPE)} SELECT {_KEYS}, ema9, ema21, prev_ema9, prev_ema21, rsi, atr, avg_vol, n_bars FROM judged",
        "filled_bars": f"""WITH bars AS ({_bars('5m', _BY_TYPE)}), s AS (SELECT *, lead(time) OVER (PARTITION BY symbol, interval ORDER BY time) AS until FROM bars),
            g AS (SELECT symbol, interval, unnest(range(time + INTERVAL 5 MINUTE, until, INTERVAL 5 MINUTE)) AS time, close FROM s WHERE until IS NOT NULL)
            SELECT {_BAR}, true AS traded FROM bars UNION ALL SELECT {_KEYS}, close, close, close, close, 0::DOUBLE, false FROM g""",
        "bar_gaps": f"""WITH bars AS ({_bars('5m', _BY_TYPE)}), s AS (SELECT *, lead(time) OVER (PARTITION BY symbol, interval ORDER BY time) AS until FROM bars)
            SELECT symbol, interval, time AS after, until, (date_diff('minute', time, until) // 5 - 1)::BIGINT AS missing FROM s WHERE until > time + INTERVAL 5 MINUTE""",
        "trading_sessions": f"""WITH bars AS ({_bars('5m', _BY_TYPE)}),
            l AS (SELECT *, coalesce(time > lag(time) OVER s + INTERVAL 30 MINUTE, true)::INTEGER AS begins FROM bars WINDOW s AS (PARTITION BY symbol, interval ORDER BY time)),
            n AS (SELECT *, sum(begins) OVER (PARTITION BY symbol, interval ORDER BY time) AS k FROM l)
            SELECT symbol, interval, min(time) AS time, max(time) AS last_time, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume,
                count(*) AS n_bars FROM n GROUP BY symbol, interval, k""",
        "volume_quantile_spikes": f"""WITH bars AS ({_bars('1h', _BY_TYPE)}), d AS (SELECT DISTINCT symbol, interval, time::DATE AS day FROM bars),
            v AS (SELECT d.*, list(b.volume ORDER BY b.volume) AS l FROM d JOIN bars b ON b.symbol = d.symbol AND b.interval = d.interval AND b.time::DATE BETWEEN d.day - 7 AND d.day - 1 GROUP BY ALL),
            q AS (SELECT symbol, interval, day, len(l) AS n_values, ceil(ln(l[floor(0.95::DOUBLE * (len(l) - 1))::BIGINT + 1]) / {_LOG}) AS bin FROM v)
            SELECT b.symbol, b.interval, b.time, volume, round(pow({_GAMMA}, bin) * 2 / (1 + {_GAMMA}), 6) AS baseline, n_values, coalesce(ceil(ln(volume) / {_LOG}) > bin, false) AS spike
            FROM bars b LEFT JOIN q ON q.symbol = b.symbol AND q.interval = b.interval AND q.day = b.time::DATE""",
        "alerts_sent": f"{_history('5m', _BY_TYPE)} SELECT {_KEYS}, direction, entry, stop, take, rr FROM judged WHERE direction <> 'NONE'",
        **dict.fromkeys(("klines_source_latest", "polled_latest"), _latest()),
        "streamed_history": f"{_history()} SELECT {_SIGNAL} FROM judged",
    }
