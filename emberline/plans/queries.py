"""The registered queries: each operator over bars resampled from the whole events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions import table
from ..operators import candles, chart
from ..operators.asof import as_of
from ..operators.gaps import filled, gaps, sessions
from ..operators.history import full_history
from ..operators.outcomes import first_touches
from ..operators.signals import cross_down, cross_up, latest_signals, signals, spike
from ..operators.sketches import quantile_spikes
from ..operators.snapshots import with_indicators, with_previous
from ..sources.payloads import from_payloads
from ..staging import staged

INTERVAL = "5m"
_KEYS = ["symbol", "interval", "time"]


def bars(spark: SparkSession, sf_dir: str, interval: str = INTERVAL, by_type: bool = False) -> DataFrame:
    """Bars of the events table, as one series or one for each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "value", "event_type")
    return candles.from_ticks(events, interval, F.col("event_type") if by_type else None)


def _candles(interval: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: bars(spark, sf_dir, interval)


def series_of_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = bars(spark, sf_dir, "1m").unionByName(bars(spark, sf_dir, "5m")).unionByName(bars(spark, sf_dir, "15m"))
    return candles.select_series(every, "ALL", "15m")


def last_300_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.newest(bars(spark, sf_dir), 300)


def closed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.closed_only(bars(spark, sf_dir, by_type=True))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's bars as a kline payload; volumes carry trailing junk, as prefixes must parse."""
    day = F.to_date("time").alias("day")
    millis = F.unix_millis(F.col("time").cast("timestamp")).cast("string")
    row = F.array(millis, *[F.col(c).cast("string") for c in ("open", "high", "low", "close")], F.concat(F.col("volume").cast("string"), F.lit("x")), F.lit("ignored"))
    return bars(spark, sf_dir).groupBy("symbol", "interval", day).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("time", row.alias("k")))), lambda r: r["k"])).alias("body"))


def klines_json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_payloads(_payloads(spark, sf_dir))


def klines_of_mixed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where some days' answers are an error object, cut off, null or empty: those give no bar, the others stand."""
    number = F.dayofmonth("day") % 5
    body = F.when(number == 1, '{"code":-1121,"msg":"Invalid symbol."}').when(number == 2, F.lit("not json")).when(number == 3, F.lit(None)).when(number == 4, F.lit("[]")).otherwise(F.col("body"))
    return from_payloads(_payloads(spark, sf_dir).withColumn("body", body), strict=False)


def price_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = with_previous(bars(spark, sf_dir))
    change = F.col("close") - F.col("prev_close")
    return chunked.select(*_KEYS, change.alias("change"), ind.positive_part(change).alias("gain"), ind.negative_part(change).alias("loss"))


def true_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = with_previous(bars(spark, sf_dir))
    return chunked.select(*_KEYS, ind.true_range(F.col("high"), F.col("low"), F.col("prev_close")).alias("true_range"))


def _indicated(*columns: str, interval: str = INTERVAL) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: with_indicators(bars(spark, sf_dir, interval)).withColumn("vol_spike", spike(F.col("volume"), F.col("avg_vol"))).select(*_KEYS, *columns)


def cross_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_indicators(bars(spark, sf_dir)).select(*_KEYS, cross_up().alias("cross_up"), cross_down().alias("cross_down"))


def signal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(bars(spark, sf_dir))


def signal_history_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(bars(spark, sf_dir, by_type=True))


def signal_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_signals(bars(spark, sf_dir, by_type=True))


def chart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.ema_lines(bars(spark, sf_dir, by_type=True))


def rsi_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.rsi_points(bars(spark, sf_dir, by_type=True))


def price_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.price_lines(signal_history(spark, sf_dir))


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.markers(signal_history(spark, sf_dir))


def info_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart.panel(signal_history(spark, sf_dir))


def every_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "value", "event_type")
    return candles.every_interval(events, ["1m", "5m", "15m", "1h"], F.col("event_type"))


def indicators_full_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded, as the chunks' maps add up in another order than a loop."""
    rows = full_history(bars(spark, sf_dir, "1m"))
    return rows.select(*_KEYS, *[F.round(c, 6).alias(c) for c in ("ema9", "ema21", "prev_ema9", "prev_ema21", "rsi")], "n_bars")


def signal_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every signal of every event type's bars: stop, take or still open."""
    series = staged(bars(spark, sf_dir, by_type=True), "bars")
    return first_touches(signals(series), series).select(*_KEYS, "direction", "entry", "stop", "take", "exit", "exit_time", "exit_price", "gain")


def signals_with_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal at every bar with the last tick of its event type at or before the bar's start, if it is at most an hour old."""
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    rows = signals(bars(spark, sf_dir, by_type=True)).select(*_KEYS, "direction")
    return as_of(rows, ticks, ["symbol"], "time", "ts", {"ts": "tick_time", "event_id": "tick_id", "value": "tick_value"}, "event_id", within_seconds=3600)


def indicators_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over every event type's bars."""
    table.register(spark)
    bars(spark, sf_dir, by_type=True).createOrReplaceTempView("candle_bars")
    return spark.sql("SELECT symbol, interval, time, ema9, ema21, prev_ema9, prev_ema21, rsi, atr, avg_vol, n_bars FROM candle_indicators(TABLE(candle_bars))")


def volume_quantile_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour of every event type against the 0.95 quantile of the hours of the seven days before, from daily sketches."""
    rows = quantile_spikes(staged(bars(spark, sf_dir, "1h", by_type=True), "bars"))
    return rows.select(*_KEYS, "volume", F.round("baseline", 6).alias("baseline"), "n_values", "spike")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "candles_1m": _candles("1m"),
        "candles_5m": _candles("5m"),
        "candles_15m": _candles("15m"),
        "series_of_interval": series_of_interval,
        "last_300_bars": last_300_bars,
        "closed_bars": closed_bars,
        "klines_json_parse": klines_json_parse,
        "klines_of_mixed_answers": klines_of_mixed_answers,
        "price_change": price_change,
        "true_range": true_ranges,
        "ema_series": _indicated("ema9", "ema21", "prev_ema9", "prev_ema21"),
        "rsi_series": _indicated("rsi"),
        "atr_head": _indicated("atr"),
        "volume_mean_spike": _indicated("avg_vol", "vol_spike"),
        "cross_flags": cross_flags,
        "signal_history": signal_history,
        "signal_history_1m": lambda spark, sf_dir: signals(bars(spark, sf_dir, "1m")),
        "signal_history_by_symbol": signal_history_by_symbol,
        "signal_latest": signal_latest,
        "chart_lines": chart_lines,
        "rsi_snapshot": rsi_snapshot,
        "price_lines": price_lines,
        "markers": markers,
        "info_panel": info_panel,
        "every_interval": every_interval,
        "indicators_full_history": indicators_full_history,
        "signal_outcomes": signal_outcomes,
        "signals_with_ticks": signals_with_ticks,
        "indicators_by_sql": indicators_by_sql,
        "filled_bars": lambda spark, sf_dir: filled(bars(spark, sf_dir, by_type=True)),
        "bar_gaps": lambda spark, sf_dir: gaps(bars(spark, sf_dir, by_type=True)),
        "trading_sessions": lambda spark, sf_dir: sessions(bars(spark, sf_dir, by_type=True), "30 minutes"),
        "volume_quantile_spikes": volume_quantile_spikes,
    }
