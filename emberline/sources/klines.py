"""A polled kline endpoint as a Spark data source, for batch and streaming reads.

    spark.dataSource.register(KlineSource)
    spark.read.format("klines").option("url", "https://host/klines?symbol={symbol}&interval={interval}&limit={limit}")
        .option("symbols", "AAA,BBB").option("intervals", "1m,5m").load()

With option("pushdown", "true"), filters on symbol and interval choose the requests. With option("numbered", "true") rows have a column seq, the time of the
poll in milliseconds, by which a later answer's version of a bar is told from an earlier one's. Each (symbol, interval) is a partition that fetches its own snapshot. Any URL that urllib opens will do, a
file: URL too.
"""

from __future__ import annotations

import json
import re
import time
import urllib.request
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

from ..operators.candles import BAR, SEQUENCE

_PREFIX = re.compile(r"\s*([+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?))")


def _number(value: object) -> float:
    """The number a value starts with, NaN if none."""
    found = _PREFIX.match(str(value))
    return float(found[1]) if found else float("nan")


class Series(InputPartition):
    def __init__(self, symbol: str, interval: str, polled: int):
        super().__init__((symbol, interval, polled))
        self.symbol, self.interval, self.polled = symbol, interval, polled


class _Settings:
    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        self.symbols = options.get("symbols", "BTCUSDT").split(",")
        self.intervals = options.get("intervals", "1m,5m,15m").split(",")
        self.limit = int(options.get("limit", 300))
        self.timeout = float(options.get("timeout", 20))
        self.numbered = options.get("numbered", "false").lower() == "true"

    def series(self, polled: int) -> list[InputPartition]:
        return [Series(s, i, polled) for s in self.symbols for i in self.intervals]

    def fetch(self, asked: Series) -> Iterator[tuple]:
        symbol, interval = asked.symbol, asked.interval
        url = self.url.format(symbol=symbol, interval=interval, limit=self.limit)
        with urllib.request.urlopen(url, timeout=self.timeout) as answer:
            rows = json.load(answer)
        if not isinstance(rows, list):
            raise ValueError(f"{symbol} {interval}: the endpoint answered {str(rows)[:200]}")
        for row in rows[-self.limit :]:
            at = datetime.fromtimestamp(float(row[0]) / 1000, UTC).replace(tzinfo=None)
            yield symbol, interval, at, *(_number(x) for x in row[1:6]), *([asked.polled] if self.numbered else [])


class KlineReader(DataSourceReader):
    def __init__(self, settings: _Settings):
        self.settings = settings

    def partitions(self) -> list[InputPartition]:
        return self.settings.series(int(time.time() * 1000))

    def read(self, partition: Series) -> Iterator[tuple]:
        yield from self.settings.fetch(partition)


class PruningKlineReader(KlineReader):
    """For sessions with spark.sql.python.filterPushdown.enabled; Spark refuses such a reader without it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """An equality on symbol or interval picks the requests to send; others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("symbol",), ("interval",)):
                name = f"{f.attribute[0]}s"
                setattr(self.settings, name, [x for x in getattr(self.settings, name) if x == f.value])
            else:
                yield f


class KlinePoller(DataSourceStreamReader):
    """Every poll is a whole snapshot of each series, fetched by a task for each; the offset is the time of the poll.

    After a failure the endpoint's present snapshot stands in for the lost one: a snapshot replaces what was
    shown before, so that does no harm.
    """

    def __init__(self, settings: _Settings):
        self.settings = settings

    def initialOffset(self) -> dict:  # noqa: N802
        return {"polled": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"polled": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.settings.series(end["polled"])

    def read(self, partition: Series) -> Iterator[tuple]:
        yield from self.settings.fetch(partition)


class KlineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return f"{BAR}, {SEQUENCE} long" if _Settings(dict(self.options)).numbered else BAR

    def reader(self, schema: object) -> DataSourceReader:
        kind = PruningKlineReader if self.options.get("pushdown", "false").lower() == "true" else KlineReader
        return kind(_Settings(dict(self.options)))

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        return KlinePoller(_Settings(dict(self.options)))
