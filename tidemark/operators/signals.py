"""Crossover signals with angle and trend gates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import indicators
from tidemark.functions.schemas import StrategyConfig


def gates(fast: Column, slow: Column, fast_before: Column, slow_before: Column, angle: Column, close: Column, threshold: Column, mode: Column) -> tuple[Column, Column, Column]:
    """(buy, sell, crossover) of a bar; parameters are columns, so one plan serves many configurations."""
    up = (fast > slow) & (fast_before <= slow_before)
    down = (fast < slow) & (fast_before >= slow_before)
    gated = mode != "crossover"
    trend = mode == "crossover_angle_and_trend"
    buy = up & (~gated | (angle >= threshold)) & (~trend | (close > slow))
    sell = down & (~gated | (angle <= -threshold)) & (~trend | ~(close > slow))
    return buy, sell, up | down


def decide(*values: Column) -> tuple[Column, Column]:
    """(signal_type, crossover) of a bar from the values of ``gates``."""
    buy, sell, crossed = gates(*values)
    return F.when(buy, "BUY").when(sell, "SELL").otherwise("HOLD"), F.coalesce(crossed, F.lit(False))


def generate_signals(bars: DataFrame, config: StrategyConfig = StrategyConfig(), by: Sequence[str] = ("instrument",), keep: Sequence[str] = ()) -> DataFrame:
    """One row for each bar: ``by``, timestamp, ``keep``, signal_type, crossover, ema_fast, ema_slow, angle, candle_close.

    A bar sees itself and earlier bars only. Bars before the slow average's
    warm-up is over are HOLD. ``keep`` carries columns such as open along, so
    that a backtest need not join signals and bars again.
    """
    w = indicators.series(by)
    rows = indicators.with_emas(bars.select(*by, "timestamp", "close", *[c for c in keep if c != "close"]), (config.fast_ema, config.slow_ema), by)
    fast, slow = indicators.ema_name(config.fast_ema), indicators.ema_name(config.slow_ema)
    rows = rows.withColumns({"__angle": indicators.angle(fast, by, config.angle_lookback, config.angle_scale), "__f": F.lag(fast).over(w), "__s": F.lag(slow).over(w)})
    kind, crossed = decide(F.col(fast), F.col(slow), F.col("__f"), F.col("__s"), F.col("__angle"), F.col("close"), F.lit(config.angle_threshold), F.lit(config.signal_mode))
    return rows.select(*by, "timestamp", *keep, kind.alias("signal_type"), crossed.alias("crossover"), F.col(fast).alias("ema_fast"), F.col(slow).alias("ema_slow"), F.col("__angle").alias("angle"), F.col("close").alias("candle_close"))


def _axes(configs: Sequence[tuple[str, StrategyConfig]]) -> tuple[list[int], list[tuple]]:
    """The distinct periods, and the distinct (period, lookback, scale) of angles."""
    periods = sorted({p for _, c in configs for p in (c.fast_ema, c.slow_ema)})
    return periods, sorted({(c.fast_ema, c.angle_lookback, c.angle_scale) for _, c in configs})


def with_arrays(bars: DataFrame, configs: Sequence[tuple[str, StrategyConfig]], by: Sequence[str] = ("instrument",)) -> DataFrame:
    """``bars`` with the averages of all periods now and one bar before, and all angles, as arrays; each is computed once."""
    w = indicators.series(by)
    periods, slopes = _axes(configs)
    names = [indicators.ema_name(p) for p in periods]
    rows = indicators.with_emas(bars, periods, by)
    rows = rows.withColumns({f"__b{i}": F.lag(n).over(w) for i, n in enumerate(names)} | {f"__a{i}": indicators.angle(indicators.ema_name(p), by, k, s) for i, (p, k, s) in enumerate(slopes)})
    before, angles = [f"__b{i}" for i in range(len(names))], [f"__a{i}" for i in range(len(slopes))]
    return rows.withColumns({"__now": F.array(*names), "__before": F.array(*before), "__angles": F.array(*angles)}).drop(*names, *before, *angles)


def _pairs(configs: Sequence[tuple[str, StrategyConfig]]) -> Column:
    """The configurations under each pair of averages: (f, s, members of (id, a, t, m)), by places in the arrays."""
    periods, slopes = _axes(configs)
    found: dict = {}
    for i, c in configs:
        place = slopes.index((c.fast_ema, c.angle_lookback, c.angle_scale))
        found.setdefault((c.fast_ema, c.slow_ema), []).append(F.struct(F.lit(i).alias("id"), F.lit(place).alias("a"), F.lit(float(c.angle_threshold)).alias("t"), F.lit(c.signal_mode).alias("m")))
    return F.array(*[F.struct(F.lit(periods.index(f)).alias("f"), F.lit(periods.index(s)).alias("s"), F.array(*members).alias("members")) for (f, s), members in found.items()])


def _values(pair: Column, member: Column) -> tuple:
    now, before = (lambda k: F.get("__now", pair[k])), (lambda k: F.get("__before", pair[k]))
    return now("f"), now("s"), before("f"), before("s"), F.get("__angles", member["a"]), F.col("close"), member["t"], member["m"]


def fired(rows: DataFrame, configs: Sequence[tuple[str, StrategyConfig]], name: str = "config_id") -> DataFrame:
    """One row (``name``, sig 1 or -1, the columns of ``rows``) for each bar and configuration that signals.

    ``rows`` has the arrays of ``with_arrays``. A bar is looked at by pair of
    averages first; only where they cross come the pair's configurations, so bars
    that hold, nearly all, never become a row for each configuration.
    """
    crosses = lambda p: F.coalesce(F.signum(F.get("__now", p["f"]) - F.get("__now", p["s"])) * F.signum(F.get("__before", p["f"]) - F.get("__before", p["s"])) <= 0, F.lit(False))

    def signed(pair, member):
        buy, sell, _ = gates(*_values(pair, member))
        return F.struct(member["id"].alias("id"), F.when(buy, 1).when(sell, -1).otherwise(0).alias("sig"))

    each = F.flatten(F.transform(F.filter(_pairs(configs), crosses), lambda p: F.transform(p["members"], lambda c: signed(p, c))))
    out = rows.withColumn("__hit", F.explode(F.filter(each, lambda h: h["sig"] != 0)))
    return out.select(F.col("__hit.id").alias(name), F.col("__hit.sig").alias("sig"), *[c for c in rows.columns if c not in ("__now", "__before", "__angles")])


def signals_for_many(bars: DataFrame, configs: Iterable[tuple[str, StrategyConfig]], by: Sequence[str] = ("instrument",), name: str = "config_id", keep: Sequence[str] = ("open", "close")) -> DataFrame:
    """``generate_signals`` of all configurations in one plan, told apart by ``name``: a row for every bar and configuration.

    Each distinct average and angle is computed once; only then does a row
    become one for each configuration.
    """
    configs = list(configs)
    rows = with_arrays(bars.select(*by, "timestamp", "close", *[c for c in keep if c != "close"]), configs, by)
    each = rows.withColumn("p", F.explode(_pairs(configs))).withColumn("c", F.explode("p.members"))
    kind, crossed = decide(*_values(F.col("p"), F.col("c")))
    return each.select(F.col("c.id").alias(name), *by, "timestamp", *keep, kind.alias("signal_type"), crossed.alias("crossover"))


def signal_events(signals: DataFrame) -> DataFrame:
    """The bars that signal."""
    return signals.where("signal_type <> 'HOLD'")


def signal_counts(signals: DataFrame, by: Sequence[str] = ("instrument",)) -> DataFrame:
    return signals.groupBy(*by).agg(F.count_if(F.col("signal_type") == "BUY").alias("buys"), F.count_if(F.col("signal_type") == "SELL").alias("sells"), F.count_if(F.col("crossover")).alias("crossovers"), F.count("*").alias("bars"))
