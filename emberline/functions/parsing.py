"""Decoding of kline payloads: JSON arrays of positional arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAYLOAD = "array<array<string>>"
_NUMBER = r"^\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))"


def parse_float(text: Column) -> Column:
    """The double that a text starts with, NaN if it starts with none or is null; what follows is ignored."""
    found = F.regexp_extract(text, _NUMBER, 1)
    return F.coalesce(F.when(found != "", found.try_cast("double")), F.lit(float("nan")))


def decode(body: Column) -> Column:
    """A payload's rows; null when it is no array of arrays (an error object, say, or no JSON)."""
    return F.from_json(body, PAYLOAD)


def kline(row: Column) -> list[Column]:
    """time (from epoch milliseconds), open, high, low, close, volume of a positional row; further positions are ignored."""
    millis = F.get(row, F.lit(0)).try_cast("double")
    prices = [parse_float(F.get(row, F.lit(i))).alias(name) for i, name in enumerate(("open", "high", "low", "close", "volume"), 1)]
    return [F.timestamp_millis(millis.cast("long")).cast("timestamp_ntz").alias("time"), (millis / 1000).alias("time_s"), *prices]
