import datetime as dt

import pytest

from tests.frames import candles, closes, research_month, wave
from tidemark.functions.schemas import NORMAL_SLIPPAGE, BacktestConfig, StrategyConfig
from tidemark.operators import backtest, contracts, regime, research, risk, signals

GRID = {"fast_ema": (5, 9), "slow_ema": (15, 21), "angle_threshold": (20.0, 30.0), "angle_lookback": (1, 2)}


def test_default_grid_and_order():
    found = research.grid_configs()
    assert len(found) == 320 and found[0][0] == "RE-0001" and all(c.fast_ema < c.slow_ema for _, c in found)
    assert len(research.grid_configs({**GRID, "fast_ema": (5, 30)})) == 8


def test_grid_equals_single_runs(spark):
    df = research_month(spark)
    window = (dt.datetime(2026, 7, 1), dt.datetime(2026, 7, 24))
    found = research.grid_search(df, window, GRID, backtest_config=BacktestConfig(slippage=NORMAL_SLIPPAGE)).collect()
    assert len(found) == 16 and sorted(r.rank for r in found) == list(range(1, 17))
    best = min(found, key=lambda r: r["rank"])
    assert best.net_pnl == max(r.net_pnl for r in found)
    for r in found[:3]:
        config = StrategyConfig(r.fast_ema, r.slow_ema, r.angle_threshold, r.angle_lookback)
        rows = signals.generate_signals(research.within(df, window), config, keep=("open", "close"))
        one = backtest.run_backtest(rows, BacktestConfig(slippage=NORMAL_SLIPPAGE))[2].first()
        assert (r.total_trades, r.net_pnl, r.sharpe) == (one.total_trades, pytest.approx(one.net_pnl), pytest.approx(one.sharpe))


def test_splits(spark):
    got = {r.split: (r.start, r.end) for r in research.split_schedule(research_month(spark)).collect()}
    day = lambda d, m=7: dt.datetime(2026, m, d)
    assert got == {"train": (day(1), day(24)), "validation": (day(24), day(28)), "test": (day(28), day(1, 8))}


def test_walk_windows_are_half_open(spark):
    got = research.walk_windows(research_month(spark)).orderBy("step").collect()
    assert [(r.train_start.day, r.train_end.day, r.test_start.day, r.test_end.day) for r in got] == [(1, 15, 16, 21), (1, 20, 21, 26), (1, 25, 26, 31)]
    assert research.walk_windows(research_month(spark, 10)).count() == 0


@pytest.mark.parametrize(("days", "test_days"), [(19, 5), (31, 5), (30, 3), (28, 7)])
def test_steps_hold_the_bars_of_their_windows(spark, days, test_days):
    df = research_month(spark, days)
    windows = research.walk_windows(df, ("instrument",), test_days).collect()
    span = research._span(df, ("instrument",), test_days)
    times = sorted(r.timestamp for r in df.collect())
    for part in ("train", "test"):
        got = sorted((r.step, r.timestamp) for r in research.in_steps(df, span, part, ("instrument",), test_days).collect())
        assert got == sorted((w.step, t) for w in windows for t in times if w[f"{part}_start"] <= t < w[f"{part}_end"])


def test_grid_table_equals_grid_configs(spark):
    from pyspark.sql import functions as F

    axes = spark.range(1).select(*[F.array(*map(F.lit, research.GRID[p])).alias(p) for p in research.PARAMETERS])
    got = [tuple(r) for r in research.grid_table(axes).orderBy("experiment_id").collect()]
    assert got == [(i, c.fast_ema, c.slow_ema, c.angle_threshold, c.angle_lookback) for i, c in research.grid_configs()]


def test_walk_forward_uses_training_bars_only(spark):
    df = research_month(spark)
    config = BacktestConfig(slippage=NORMAL_SLIPPAGE)
    steps = research.walk_forward(df, GRID, backtest_config=config).orderBy("step").collect()
    assert len(steps) == 3
    for s in steps:
        best = research.grid_search(df, (s.train_start, s.train_end), GRID, backtest_config=config).where("rank = 1").first()
        assert (best.experiment_id, best.net_pnl) == (s.experiment_id, pytest.approx(s.train_net_pnl))
    changed = df.selectExpr("instrument", "timestamp", *[f"IF(timestamp >= TIMESTAMP_NTZ'2026-07-16 00:00:00', {c} * 1.5, {c}) AS {c}" for c in ("open", "high", "low", "close")], "volume", "open_interest")
    assert research.walk_forward(changed, GRID, backtest_config=config).where("step = 1").first().experiment_id == steps[0].experiment_id


def test_too_short_for_walking(spark):
    with pytest.raises(ValueError):
        research.walk_forward(research_month(spark, 10), GRID)


def regime_bars(spark):
    rows = []
    for day, share in ((1, 0.02), (2, 0.007), (4, 0.01)):
        for hour in (10, 11, 12):
            rows.append(("A", dt.datetime(2026, 7, day, hour), 100.0, 100 + 50 * share, 100 - 50 * share, 100.0, 1, 1))
    return candles(spark, rows)


TRADES = "instrument string, entry_time timestamp_ntz, net_pnl double, gross_pnl double"


def test_regimes(spark):
    df = regime_bars(spark)
    assert {r.day_of.day: r.regime for r in regime.day_regimes(df).collect()} == {1: "high", 2: "low", 4: "mid"}
    trades = spark.createDataFrame([("A", dt.datetime(2026, 7, d, 10), n, g) for d, n, g in ((1, 500.0, 600.0), (2, -200.0, -180.0), (3, 9.0, 9.0))], TRADES)
    out = regime.regime_summary(df, trades).orderBy("position").collect()
    assert [(r.regime, r.days, r.trades, r.net_pnl, r.win_rate) for r in out] == [("high", 1, 1, 500.0, 1.0), ("mid", 1, 0, 0.0, 0.0), ("low", 1, 1, -200.0, 0.0)]
    none = regime.regime_summary(df, trades.where("net_pnl > 1e9")).collect()
    assert {(r.days, r.trades) for r in none} == {(0, 0)}


def test_baseline_matrix_and_hash(spark):
    from pyspark.sql import functions as F

    df = closes(spark, wave()).withColumn("timeframe", F.lit("1m"))
    df = df.unionByName(df.withColumn("timeframe", F.lit("5m")))
    trades, found = research.run_baseline(df, by=("timeframe",))
    assert found.count() == 6
    table = {r.variant: (r["1m"], r["5m"]) for r in research.matrix(found, "total_trades", ["1m", "5m"]).collect()}
    assert set(table) == {"A", "B", "C"} and table["A"][0] >= table["B"][0] == table["C"][0] and table["A"][0] > 0
    assert StrategyConfig().digest() == StrategyConfig().digest() != StrategyConfig(fast_ema=8).digest()
    assert trades.where("variant = 'A'").count() == sum(table["A"])


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, research.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_risk_limits(spark):
    trades = spark.createDataFrame([("A", i, dt.datetime(2026, 7, 1, 10), -20_000.0) for i in range(1, 8)], "instrument string, trade_id long, entry_time timestamp_ntz, net_pnl double")
    day = risk.daily_limits(trades).first()
    assert (day.trades, day.too_many, day.loss_limit) == (7, False, True)
    assert [r.refused for r in risk.trade_limits(trades).orderBy("trade_id").collect()] == [False] * 5 + [True] * 2


def test_contract_policies(spark):
    rows = [("k1", dt.date(2026, 7, 30)), ("k2", dt.date(2026, 8, 25)), ("k3", dt.date(2026, 9, 29))]
    master = spark.createDataFrame([(*r, "NIFTY", "FUT") for r in rows] + [("k9", dt.date(2026, 7, 2), "BANKNIFTY", "FUT"), ("k8", dt.date(2026, 7, 2), "NIFTY", "CE")], "instrument_key string, expiry date, underlying_symbol string, instrument_type string")
    futures = contracts.index_futures(master)
    assert futures.count() == 3
    assert contracts.expiring_in_month(futures, 2026, 7).first().instrument_key == "k1"
    assert contracts.expiring_in_month(futures, 2026, 10).count() == 0
    assert contracts.active_on(futures, dt.date(2026, 7, 31)).first().instrument_key == "k2"


def test_expired_and_found_contracts(spark):
    master = spark.createDataFrame([("k1", dt.date(2026, 7, 30)), ("k2", dt.date(2026, 8, 25))], "instrument_key string, expiry date").selectExpr("*", "'NIFTY' AS underlying_symbol", "'FUT' AS instrument_type")
    assert [r.instrument_key for r in contracts.expired(master, dt.date(2026, 8, 1)).collect()] == ["k1"]
    assert contracts.find_future(master, dt.date(2026, 8, 25)).first().instrument_key == "k2"
    assert contracts.find_future(master, dt.date(2026, 8, 26)).count() == 0


def test_registry_and_months(spark):
    df = closes(spark, wave())
    configs = research.baseline_variants()
    rows = signals.signals_for_many(df, configs, name="experiment_id")
    trades, _, found = backtest.run_backtest(rows, by=["experiment_id", "instrument"])
    table = research.registry(found, configs, "d1").collect()
    assert {r.config_hash for r in table} == {c.digest() for _, c in configs} and {(r.dataset_version, r.strategy_version, r.engine_version) for r in table} == {("d1", "ema_9_15_angle_v1", "0.1.0")}
    assert {r.month for r in research.monthly_performance(trades, ("experiment_id",)).collect()} == {"2026-07"}


def test_day_checks(spark):
    from tidemark.operators import quality

    rows = [("A", dt.datetime(2026, 7, d, 10), p, p, p, p, v, 1) for d, p, v in ((1, 100.0, 10), (2, 101.0, 10), (3, 120.0, 100), (7, 120.0, 10))]
    got = {r.day_of.day: r for r in quality.day_checks(candles(spark, rows), share=2.0).collect()}
    assert [got[d].open_gap for d in (1, 2, 3, 7)] == [False, False, True, False]
    assert got[3].odd_volume and got[7].missing_weekdays == 1 and got[2].missing_weekdays == 0


def test_registered_grid_finds_its_window_in_other_years(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.plans import catalog

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.withColumn("ts", F.col("ts") + F.expr("INTERVAL 700 DAYS")).write.parquet(str(tmp_path / "later" / "events.parquet"))
    events.limit(0).write.parquet(str(tmp_path / "none" / "events.parquet"))
    rows = lambda path: sorted(map(tuple, catalog.grid_search(spark, path).collect()))
    assert rows(str(tmp_path / "later")) == rows("/root/testdata/sf0.001") != []
    assert rows(str(tmp_path / "none")) == []
