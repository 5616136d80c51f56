"""Indicators as a table function, for SQL.

    register(spark)
    SELECT * FROM candle_indicators(TABLE(bars))
    SELECT * FROM candle_indicators(TABLE(bars), 120)      -- snapshots of 120 bars

The function itself asks for its table by series in order of time. It passes over a series once and holds a chunk of bars, but a series is one task's;
operators.snapshots.with_indicators spreads a long one over many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from ..operators.candles import KEY, VALUES
from ..operators.snapshots import CHUNK, INDICATED
from .kernel import SNAPSHOT, indicators

_KINDS = {"string": StringType(), "timestamp_ntz": TimestampNTZType(), "double": DoubleType(), "int": IntegerType()}
_COLUMNS = [x.split()[0] for x in INDICATED.split(", ")]
#: analyze runs where no session is, so the schema can't be parsed there.
_SCHEMA = StructType([StructField(name, _KINDS[kind]) for name, kind in (x.split() for x in INDICATED.split(", "))])


class CandleIndicators:
    """Takes a table of bars, of any further columns, and gives a row of indicators for each, from the last `size` bars of its series alone."""

    @staticmethod
    def analyze(bars: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not bars.isTable:
            raise ValueError("the first argument must be a table of bars: candle_indicators(TABLE(bars))")
        missing = {*KEY, "time", *VALUES} - {f.name.lower() for f in bars.dataType.fields}
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        if size is not None and (not size.isConstantExpression or size.value is None or not 1 <= size.value <= CHUNK):
            raise ValueError(f"the size of a snapshot must be a number from 1 to {CHUNK}")
        return AnalyzeResult(_SCHEMA, partitionBy=[PartitioningColumn(c) for c in KEY], orderBy=[OrderingColumn(c) for c in ("time", *VALUES)])

    def __init__(self):
        self.size, self.lead, self.rows = SNAPSHOT, 0, []

    def eval(self, bar: Row, size: int = SNAPSHOT) -> Iterator[tuple]:
        self.size = size
        self.rows.append((bar["symbol"], bar["interval"], bar["time"], *(float("nan") if bar[c] is None else float(bar[c]) for c in ("high", "low", "close", "volume"))))
        if len(self.rows) - self.lead >= CHUNK:
            yield from self._made()

    def terminate(self) -> Iterator[tuple]:
        if len(self.rows) > self.lead:
            yield from self._made()

    def _made(self) -> Iterator[tuple]:
        """The rows of the bars since the last time; what the next ones need of them stays."""
        numbers = np.array([row[3:] for row in self.rows], dtype=np.float64).T
        found = indicators(*numbers, lead=self.lead, size=self.size)
        own = self.rows[self.lead :]
        columns = [found[c].tolist() for c in _COLUMNS[5:]]
        at = {c: i for i, c in enumerate(_COLUMNS[5:])}
        for i, row in enumerate(own):
            values = [column[i] for column in columns]
            if values[at["n_bars"]] == 1:
                values[at["prev_ema9"]] = values[at["prev_ema21"]] = None
            yield (*row[:3], *row[5:7], *values)
        self.rows = self.rows[-(self.size - 1) :] if self.size > 1 else []
        self.lead = len(self.rows)


def register(spark: SparkSession, name: str = "candle_indicators") -> None:
    """Makes the function known to the session's SQL."""
    spark.udtf.register(name, udtf(CandleIndicators))
