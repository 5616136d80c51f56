import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.functions.formatting import price, to_fixed
from emberline.functions.parsing import parse_float
from emberline.operators.candles import BAR
from emberline.operators.chart import PORTUGUESE, markers, panel
from emberline.operators.signals import SIGNAL, signals
from emberline.sources.klines import KlineSource
from emberline.sources.payloads import from_payloads, read_payload_files
from emberline.streaming.polling import bars_of_stream, poll_signals, read_shown, shown_at, stream_signals

ROWS = [[1704067200000 + 300_000 * i, str(10 + i % 7), str(12.5 + i % 7), "9.25", f"{11 + i % 5}.5", str(100 * (i % 3)), "x", 1] for i in range(40)]


def test_parse_float(spark):
    cases = {"12abc": 12.0, "": None, "junk": None, " 7.5 ": 7.5, "-.5e1x": -5.0, "+3.": 3.0, "1.5d": 1.5, "Infinity": float("inf"), "0x10": 0.0, ".": None}
    frame = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    found = {r[0]: r[1] for r in frame.select("t", parse_float(frame.t)).collect()}
    assert found.pop(None) != found.get("12abc")
    for text, value in cases.items():
        assert found[text] == value if value is not None else found[text] != found[text], text


def test_payloads(spark):
    frame = spark.createDataFrame([("A", "5m", json.dumps(ROWS)), ("B", "5m", "[]")], "symbol string, interval string, body string")
    found = from_payloads(frame).orderBy("time").collect()
    assert len(found) == 40 and found[1]["close"] == 12.5 and str(found[1]["time"]) == "2024-01-01 00:05:00"


@pytest.mark.parametrize("body", ['{"code":-1121,"msg":"Invalid symbol."}', "no json", "", None])
def test_bad_payloads_raise_or_are_left_out(spark, body):
    frame = spark.createDataFrame([("A", "5m", body)], "symbol string, interval string, body string")
    assert from_payloads(frame, strict=False).count() == 0
    with pytest.raises(Exception, match="no kline payload"):
        from_payloads(frame).collect()


def test_to_fixed(spark):
    values = [1.005, 2.675, 0.125, -0.125, 1e6, float("nan"), None]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in frame.select(to_fixed(frame.x, 2)).collect()] == ["1.00", "2.67", "0.13", "-0.13", "1000000.00", "NaN", None]
    shown = spark.createDataFrame([(None,), (0.0,), (float("nan"),), (3.456,)], "x double")
    assert [r[0] for r in shown.select(price(shown.x)).collect()] == ["-", "-", "-", "US$ 3.46"]


@pytest.fixture()
def endpoint(tmp_path):
    for symbol, shift in (("AAA", 0), ("BBB", 3)):
        (tmp_path / f"{symbol}-5m.json").write_text(json.dumps(ROWS[shift:]))
    (tmp_path / "BAD-5m.json").write_text('{"code": -1}')
    return f"file://{tmp_path}/{{symbol}}-{{interval}}.json"


def test_source_reads_and_prunes(spark, endpoint, tmp_path):
    spark.dataSource.register(KlineSource)
    read = lambda symbols, limit=300: spark.read.format("klines").option("url", endpoint).option("symbols", symbols).option("intervals", "5m").option("limit", limit).load()
    assert read("AAA,BBB").count() == 77
    assert read("AAA,BBB", 10).groupBy("symbol").count().orderBy("symbol").collect() == [("AAA", 10), ("BBB", 10)]
    with pytest.raises(Exception, match="endpoint answered"):
        read("BAD").collect()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pruned = spark.read.format("klines").option("url", endpoint).option("symbols", "AAA,BAD").option("intervals", "5m").option("pushdown", "true").load()
    assert pruned.where("symbol = 'AAA'").count() == 40
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    by_file = read_payload_files(spark, f"{tmp_path}/AAA-5m.json", "AAA", "5m")
    assert by_file.exceptAll(read("AAA")).count() == 0


def test_poll(spark, endpoint, tmp_path):
    spark.dataSource.register(KlineSource)
    stream = spark.readStream.format("klines").option("url", endpoint).option("symbols", "AAA,BBB").option("intervals", "5m").load()
    seen = []
    query = poll_signals(stream, lambda df, n: seen.append([r.asDict() for r in df.collect()]), seconds=0, checkpointLocation=str(tmp_path / "poll"))
    until = time.time() + 90
    while not seen and time.time() < until:
        time.sleep(0.5)
    query.stop()
    batch = spark.read.format("klines").option("url", endpoint).option("symbols", "AAA,BBB").option("intervals", "5m").load()
    expected = {r["symbol"]: r.asDict() for r in signals(batch).collect() if r["n_bars"] == {"AAA": 40, "BBB": 37}[r["symbol"]]}
    assert {r["symbol"]: r for r in seen[0]} == expected


def test_stream_upserts_and_knows_nan(spark, tmp_path):
    start, nan = datetime(2024, 1, 1), float("nan")
    bar = lambda i, close, high=None: ("A", "5m", start + timedelta(minutes=5 * i), 1.0, 200.0 if high is None else high, 1.0, close, 10.0)
    first = [bar(i, 100.0 + i % 7) for i in range(320)]
    batches = [first[:10] + first[11:], [bar(319, 90.0)], [first[10], first[50], bar(320, None), bar(321, 101.0, nan), ("A", "5m", None, 1.0, 1.0, 1.0, 1.0, 1.0)], [first[3], bar(322, 99.0)]]
    batches += [[bar(i, 100.0 + i % 5) for i in range(323, 700)], [bar(2, 7.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, BAR).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
        time.sleep(1.1)
    stream = spark.readStream.schema(BAR).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bars"))
    sent = []
    keep = lambda df, n: sent.extend((n, r.asDict()) for r in df.collect())
    stream_signals(stream).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(180)
    by_time = {r["time"]: r for _, r in sorted(sent, key=lambda x: x[0])}
    final = {b[2]: b for rows in batches[:-1] for b in rows if b[2] is not None}
    batch = {r["time"]: r.asDict() for r in signals(spark.createDataFrame(list(final.values()), BAR)).collect()}
    too_old = start + timedelta(minutes=10)
    assert by_time[too_old]["n_bars"] == 0 and by_time[too_old]["direction"] == "NONE"
    assert set(by_time) == set(batch)
    for at, want in batch.items():
        assert at == too_old or all(repr(by_time[at][c]) == repr(want[c]) for c in SIGNAL), at
    assert len([1 for n, r in sent if r["time"] == start + timedelta(minutes=50 * 5)]) == 2  # once when it came, once when the bar before it did


def test_shown_snapshot_is_replaced(spark, tmp_path):
    path = str(tmp_path / "shown")
    for n, symbol in enumerate("AB"):
        shown_at(path)(spark.createDataFrame([(symbol, 1)], "symbol string, x int"), n)
    assert [r["symbol"] for r in read_shown(spark, path).collect()] == ["B"]


def test_labels_and_clock(spark):
    row = spark.range(1).selectExpr("'A' AS symbol", "'5m' AS interval", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS time", "'BUY' AS direction", "2D AS entry", "1D AS stop", "3.5D AS take", "'1:1.5' AS rr", "1D AS atr", "1D AS ema9", "1D AS ema21", "60D AS rsi", "true AS vol_spike")
    assert markers(row, PORTUGUESE).first()["text"] == "COMPRA" and markers(row).first()["text"] == "BUY"
    shown = panel(row, PORTUGUESE, F.lit(datetime(2024, 1, 1, 9, 8, 7))).first()
    assert (shown["direction"], shown["css_class"], shown["last_update"]) == ("COMPRA", "signal buy", "Atualizado: 09:08:07")


def test_stream_equals_batch(spark, tmp_path):
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_id", "value").orderBy("ts").collect()
    schema = "ts timestamp_ntz, event_id long, value double"
    for i in range(0, 1000, 250):
        spark.createDataFrame(ticks[i : i + 250], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks"))
    keep = lambda df, n: df.coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
    bars_of_stream(stream, "15m").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start().awaitTermination(120)
    finished = spark.readStream.schema(BAR).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bars"))
    query = stream_signals(finished).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    from emberline.operators.candles import from_ticks

    batch = {r["time"]: r.asDict() for r in signals(from_ticks(spark.createDataFrame(ticks, schema), "15m")).collect()}
    streamed = [r.asDict() for r in spark.table("streamed").collect()]
    assert len(streamed) > 800
    assert all(batch[r["time"]][c] == r[c] for r in streamed for c in SIGNAL)
