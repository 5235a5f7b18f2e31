import datetime as dt
import json

from pyspark.sql import functions as F

from tests.frames import closes, wave
from tidemark.functions.schemas import MODES, StrategyConfig
from tidemark.operators import backtest, bars, signals
from tidemark.streaming import bars as streaming

START = dt.datetime(2026, 7, 1, 9, 15)


def ticks(n=600):
    return [(f"e{i}", START + dt.timedelta(seconds=7 * i), "A" if i % 3 else "B", 100.0 + (i * 37 % 50), 1) for i in range(n)]


SCHEMA = "event_id string, ts timestamp, instrument string, price double, quantity long"


def run(spark, stream, mode="append"):
    query = stream.writeStream.format("memory").queryName(name := f"q{abs(hash(str(id(stream))))}").outputMode(mode).start()
    streaming.replay(query)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_stream_bars_equal_batch_bars_and_ignore_repeats(spark, tmp_path):
    rows = ticks()
    path = str(tmp_path / "ticks")
    spark.createDataFrame(rows + rows[10:20], SCHEMA).coalesce(1).write.parquet(path)
    source = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    got = {(r.instrument, r.timestamp): tuple(r)[2:] for r in run(spark, streaming.named(streaming.stream_bars(source(), 1)))}
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    want = {(r.instrument, r.timestamp): tuple(r)[2:] for r in bars.bars_from_events(frame, 1, "instrument", "price").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 8
    rolled = run(spark, streaming.named(streaming.roll_up(streaming.stream_bars(source(), 1), 5)))
    five = {(r.instrument, r.timestamp): tuple(r)[2:] for r in bars.bars_from_events(frame, 5, "instrument", "price").collect()}
    assert rolled and all(five[r.instrument, r.timestamp] == tuple(r)[2:] for r in rolled)


def test_envelopes(spark):
    payload = json.dumps({"instrument": "A", "price": 10.5, "quantity": 3})
    lines = [(json.dumps({"event_id": "1", "event_type": "tick", "source": "x", "ts": "2026-07-01T09:15:00Z", "payload": payload}),), ("broken",), (json.dumps({"event_type": "heartbeat"}),)]
    (row,) = streaming.parse_ticks(spark.createDataFrame(lines, "value string")).collect()
    assert (row.event_id, row.instrument, row.price, row.quantity) == ("1", "A", 10.5, 3)


def test_stream_signals_equal_batch_signals(spark, tmp_path):
    df = closes(spark, wave(160)).unionByName(closes(spark, [x * 1.1 + (i % 7) for i, x in enumerate(wave(160))], instrument="B"))
    path = str(tmp_path / "bars")
    stamped = df.withColumn("timestamp", F.col("timestamp").cast("timestamp")).select("instrument", "timestamp", "close")
    for low, high in ((0, 50), (50, 110), (110, 160)):
        part = stamped.where((F.minute("timestamp") + 60 * F.hour("timestamp") - 555).between(low, high - 1))
        part.coalesce(1).write.mode("append").parquet(path)
    config = StrategyConfig(signal_mode=MODES[0])
    stream = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {(r.instrument, r.timestamp): r for r in run(spark, streaming.stream_signals(stream, config))}
    batch = signals.generate_signals(df, config, keep=("open", "close")).collect()
    assert len(got) == len(batch) == 320
    for r in batch:
        g = got[r.instrument, r.timestamp]
        assert g.signal_type == r.signal_type and (r.ema_slow is None or abs(g.ema_slow - r.ema_slow) < 1e-9)
    held = backtest.positions(signals.generate_signals(df, config, keep=("open", "close"))).collect()
    assert all(got[r.instrument, r.timestamp].position == r.position for r in held)


def test_messages_round_trip_and_kafka_options(spark):
    rows = spark.createDataFrame([("A", 10.5, 3)], "instrument string, price double, quantity long")
    back = streaming.parse_ticks(streaming.envelope(rows, "tick", "test")).first()
    assert (back.instrument, back.price, back.quantity) == ("A", 10.5, 3)
    assert streaming.kafka_options("h:1", streaming.topics()["ticks"], 5)["startingTimestamp"] == "5"
    assert streaming.kafka_options("h:1", "t")["startingOffsets"] == "latest"


def tick_client(options, position):
    """Three envelopes a call, nine in all."""
    if position >= 9:
        return [], position
    rows = [{"event_id": f"e{i}", "event_type": "tick", "source": "here", "ts": f"2026-07-01T09:15:{5 * i:02d}Z", "payload": json.dumps({"instrument": "A", "price": 100.0 + i, "quantity": 1})} for i in range(position, position + 3)]
    return rows, position + 3


def test_tick_source_reads_and_reads_again():
    from tidemark.streaming.ticks import TickSource

    reader = TickSource({"client": "tests.test_streaming:tick_client"}).simpleStreamReader(None)
    first, after = reader.read(reader.initialOffset())
    second, end = reader.read(after)
    again = list(reader.readBetweenOffsets({"position": 0}, end))
    assert again == [*first, *second] and end == {"position": 6} and json.loads(again[0][0])["event_id"] == "e0"
    assert list(reader.read({"position": 9})[0]) == []


def test_heartbeats_and_topic_writer(spark, tmp_path):
    from tidemark.streaming import ticks as live

    rows = [(json.dumps(x),) for x in tick_client({}, 0)[0] + tick_client({}, 3)[0] + tick_client({}, 6)[0]]
    counted = live.heartbeats(spark.createDataFrame(rows, "value string"), 20).orderBy("at").collect()
    assert [(r.source, r.events) for r in counted] == [("here", 4), ("here", 4), ("here", 1)]
    spark.createDataFrame(rows, "value string").write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema("value string").parquet(str(tmp_path / "m"))
    assert live.to_topic(stream.selectExpr("value AS key", "value"), "h:1", "market.ticks", str(tmp_path / "c")) is not None


def portfolio(spark, tmp_path, rows, **kw):
    from tidemark.streaming import paper

    path = str(tmp_path / f"signals{len(list(tmp_path.iterdir()))}")
    frame = rows.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    frame.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(frame.schema).parquet(path)
    return {(r.instrument, r.timestamp): r for r in run(spark, paper.stream_portfolio(stream, **kw))}


def test_paper_portfolio_equals_the_backtest(spark, tmp_path):
    from tidemark.functions.schemas import NORMAL_SLIPPAGE, BacktestConfig
    from tidemark.streaming.paper import Limits

    df = closes(spark, wave(300)).unionByName(closes(spark, [x * 1.1 + (i % 7) for i, x in enumerate(wave(300))], instrument="B"))
    rows = signals.generate_signals(df, StrategyConfig(signal_mode=MODES[0]), keep=("open", "close"))
    config = BacktestConfig(slippage=NORMAL_SLIPPAGE)
    got = portfolio(spark, tmp_path, rows, config=config, limits=Limits(max_trades=10**6, max_loss=1e12, max_losses_in_a_row=10**6, session=None))
    trades, equity, _ = backtest.run_backtest(rows, config)
    curve = equity.collect()
    assert len(got) == len(curve) == 600
    assert all(abs(got[r.instrument, r.timestamp].equity - r.equity) < 600 and abs(got[r.instrument, r.timestamp].realized - r.realized) < 1e-6 for r in curve)
    nets = sorted(round(r.net_pnl, 6) for r in got.values() if r.net_pnl is not None)
    assert nets == sorted(round(t.net_pnl, 6) for t in trades.where("closed_at_end = 0").collect()) != []


def test_paper_orders_are_refused(spark, tmp_path):
    from tidemark.functions.schemas import BacktestConfig
    from tidemark.streaming.paper import Limits

    kinds = {3: "BUY", 6: "SELL", 9: "BUY", 12: "SELL", 15: "BUY", 18: "SELL"}
    rows = spark.createDataFrame([("A", START + dt.timedelta(minutes=i), 100.0 - i, 100.0 - i, kinds.get(i, "HOLD")) for i in range(25)], "instrument string, timestamp timestamp_ntz, open double, close double, signal_type string")
    said = lambda **kw: [r.refused for _, r in sorted(portfolio(spark, tmp_path, rows, **kw).items()) if r.refused]
    assert said(limits=Limits(max_trades=2)) == ["trades", "trades"]
    assert said(limits=Limits(max_loss=100.0)) == ["loss"] * 4
    assert said(limits=Limits(max_losses_in_a_row=2)) == ["losses", "losses"]
    assert said(config=BacktestConfig(position_size=9)) == ["lots"] * 6
    assert said(limits=Limits(session=(0, 5))) == ["session"] * 6
