import random
from datetime import datetime, timedelta

import pytest

from emberline.operators.candles import BAR
from emberline.operators.gaps import filled, gaps, sessions

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng, found = random.Random(8), []
    for name, interval, minutes in (("A", "5m", 5), ("A", "1m", 1), (None, "1h", 60), ("B", "odd", 1)):
        at = START
        for _ in range(120):
            at += timedelta(minutes=minutes * rng.choice([1, 1, 1, 2, 7, 40]))
            close = float(rng.randint(1, 99))
            found.append((name, interval, at, 1.0, close + 1, 0.5, close, 3.0))
    late = START + timedelta(minutes=20_000, seconds=30)  # beside the grid
    return [*found, ("A", "5m", late, 1.0, 2.0, 1.0, 1.5, 1.0), ("one", "5m", START, 1.0, 1.0, 1.0, 1.0, 1.0)]


def series(rows):
    by = {}
    for r in rows:
        by.setdefault(r[:2], []).append(r)
    return {k: sorted(v, key=lambda r: r[2]) for k, v in by.items()}


@pytest.mark.parametrize("chunk", [16, 4096])
def test_missing_bars(spark, rows, chunk):
    want_bars, want_gaps = [(*r, True) for r in rows], []
    for (name, interval), bars in series(rows).items():
        step = timedelta(minutes={"5m": 5, "1h": 60}.get(interval, 1))
        for a, b in zip(bars, bars[1:]):
            at, n = a[2] + step, 0
            while at < b[2]:
                want_bars.append((name, interval, at, a[6], a[6], a[6], a[6], 0.0, False))
                at, n = at + step, n + 1
            if n:
                want_gaps.append((name, interval, a[2], b[2], n))
    frame = spark.createDataFrame(rows, BAR)
    assert sorted(map(repr, map(tuple, filled(frame, chunk).collect()))) == sorted(map(repr, want_bars))
    assert sorted(map(repr, map(tuple, gaps(frame, chunk).collect()))) == sorted(map(repr, want_gaps))
    assert filled(frame.limit(0)).count() == 0 and gaps(frame.limit(0)).count() == 0


def test_sessions_of_a_stream_are_those_of_the_table(spark, rows, tmp_path):
    want = []
    for (name, interval), bars in series(rows).items():
        runs = [[bars[0]]]
        for a, b in zip(bars, bars[1:]):
            if b[2] - a[2] > timedelta(minutes=30):
                runs.append([])
            runs[-1].append(b)
        want += [(name, interval, r[0][2], r[-1][2], r[0][3], max(x[4] for x in r), min(x[5] for x in r), r[-1][6], sum(x[7] for x in r), len(r)) for r in runs]
    frame = spark.createDataFrame(rows, BAR)
    assert sorted(map(repr, map(tuple, sessions(frame, "30 minutes").collect()))) == sorted(map(repr, want))

    last = ("end", "5m", START + timedelta(days=900), 1.0, 1.0, 1.0, 1.0, 1.0)  # moves the watermark past all others
    for part in (rows, [last]):
        spark.createDataFrame(part, BAR).selectExpr("* EXCEPT (time)", "cast(time AS timestamp) AS time").coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "bars")).schema).parquet(str(tmp_path / "bars")).withWatermark("time", "1 day")
    query = sessions(stream, "30 minutes").writeStream.format("memory").queryName("streamed_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    found = spark.table("streamed_sessions").selectExpr("* EXCEPT (time, last_time)", "cast(time AS timestamp_ntz) AS time", "cast(last_time AS timestamp_ntz) AS last_time")
    names = ["symbol", "interval", "time", "last_time", "open", "high", "low", "close", "volume", "n_bars"]
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, want))
