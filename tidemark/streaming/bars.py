"""Bars and signals of a tick stream.

Watermarks need zoned timestamps: wall time is taken as UTC inside a stream,
which keeps it and its buckets, and is wall time again in the results. Late
ticks beyond the watermark (two bars by default) are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.schemas import StrategyConfig

ENVELOPE = "event_id string, event_type string, source string, ts timestamp, payload string"
TICK = "instrument string, price double, quantity long"


def parse_ticks(messages: DataFrame, column: str = "value") -> DataFrame:
    """Ticks from JSON envelopes, e.g. of a Kafka topic; lines that are no tick vanish."""
    event = F.from_json(F.col(column).cast("string"), ENVELOPE)
    rows = messages.select(event.alias("e")).where("e.event_type = 'tick'")
    return rows.select(F.col("e.event_id").alias("event_id"), F.col("e.ts").alias("ts"), F.from_json("e.payload", TICK).alias("t")).select("event_id", "ts", "t.*")


def stream_bars(ticks: DataFrame, minutes: int = 1, watermark: str | None = None, unique: bool = True) -> DataFrame:
    """One row for each closed bucket of ``ticks`` (event_id, ts, instrument, price, quantity), in append mode.

    A tick that comes twice within the watermark counts once.
    """
    rows = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark or f"{2 * minutes} minutes")
    rows = rows.dropDuplicatesWithinWatermark(["instrument", "event_id"]) if unique else rows
    at = F.struct("ts", "event_id")
    out = rows.groupBy("instrument", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume")
    )
    return out


def roll_up(closed: DataFrame, minutes: int) -> DataFrame:
    """Larger bars from the closed bars of ``stream_bars``, in the same query."""
    at = F.window_time("w")
    return closed.groupBy("instrument", F.window(at, f"{minutes} minutes").alias("w2")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("w2", "w")


def named(bars: DataFrame) -> DataFrame:
    """Bars with the bucket's start as wall time."""
    return bars.select("instrument", F.to_timestamp_ntz(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss")).alias("timestamp"), "open", "high", "low", "close", "volume")


SIGNAL_ROWS = "instrument string, timestamp timestamp, signal_type string, ema_fast double, ema_slow double, angle double, candle_close double, position long"
STATE = "n long, fast double, slow double, recent array<double>, side long, last timestamp"


def stream_signals(bars: DataFrame, config: StrategyConfig = StrategyConfig()) -> DataFrame:
    """The batch strategy bar by bar: state holds both averages, the latest fast values and the position.

    ``bars`` is (instrument, timestamp, close) with zoned timestamps, in order of time
    from batch to batch. The same recursion as in batch, so replayed bars give
    the batch's signals; position is clamp(position + signal). A bar that comes twice
    or after a later one is passed over, as it would change what has been told.
    """
    import math

    # plain values: the workers need not have this package
    fast_n, slow_n, lookback, scale, threshold, mode = config.fast_ema, config.slow_ema, config.angle_lookback, config.angle_scale, config.angle_threshold, config.signal_mode
    a, b = 2 / (fast_n + 1), 2 / (slow_n + 1)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, fast, slow, recent, side, last = state.get if state.exists else (0, 0.0, 0.0, [], 0, None)
        recent, rows = list(recent), []
        for bar in pd.concat(list(parts)).sort_values("timestamp").itertuples(index=False):
            if last is not None and bar.timestamp <= pd.Timestamp(last):
                continue
            last = bar.timestamp
            before = (fast, slow) if n >= slow_n else None
            fast = bar.close if n == 0 else fast * (1 - a) + bar.close * a
            slow = bar.close if n == 0 else slow * (1 - b) + bar.close * b
            n += 1
            old = recent[-lookback] if len(recent) >= lookback else None
            angle = None if old is None else math.degrees(math.atan((fast - old) / old * scale)) if old else math.copysign(90.0, fast)
            if n >= fast_n:
                recent = (recent + [fast])[-lookback :]
            up = before is not None and fast > slow and before[0] <= before[1]
            down = before is not None and fast < slow and before[0] >= before[1]
            if mode != "crossover":
                up, down = up and angle is not None and angle >= threshold, down and angle is not None and angle <= -threshold
            if mode == "crossover_angle_and_trend":
                up, down = up and bar.close > slow, down and not bar.close > slow
            side = max(-1, min(1, side + int(up) - int(down)))
            rows.append((key[0], bar.timestamp, "BUY" if up else "SELL" if down else "HOLD", fast if n >= fast_n else None, slow if n >= slow_n else None, angle, bar.close, side))
        state.update((n, fast, slow, recent, side, last))
        yield pd.DataFrame(rows, columns=["instrument", "timestamp", "signal_type", "ema_fast", "ema_slow", "angle", "candle_close", "position"])

    return bars.groupBy("instrument").applyInPandasWithState(update, SIGNAL_ROWS, STATE, "append", GroupStateTimeout.NoTimeout)


def replay(query, timeout: float = 120) -> None:
    """Runs a query over what its source has now."""
    query.processAllAvailable()
    query.stop()


def topics(prefix: str = "market", kinds: Sequence[str] = ("ticks", "candles", "signals", "orders")) -> dict[str, str]:
    return {k: f"{prefix}.{k}" for k in kinds}


def kafka_options(servers: str, topic: str, since_ms: int | None = None) -> dict[str, str]:
    """Reader options of a topic; ``since_ms`` replays from that time on."""
    out = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "latest"}
    if since_ms is not None:
        del out["startingOffsets"]
        out["startingTimestamp"] = str(since_ms)
        out["startingOffsetsByTimestampStrategy"] = "latest"
    return out


def envelope(rows: DataFrame, event_type: str, source: str, key: str = "instrument") -> DataFrame:
    """(key, value) messages: the columns of ``rows`` as payload in an envelope with an id made of its content."""
    payload = F.to_json(F.struct(*rows.columns))
    body = F.struct(F.sha2(payload, 256).alias("event_id"), F.lit(event_type).alias("event_type"), F.lit(source).alias("source"), F.current_timestamp().alias("ts"), payload.alias("payload"))
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))
