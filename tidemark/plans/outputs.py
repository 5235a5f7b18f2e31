"""Result tables and small text files of the command line, wherever the paths lead."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.schemas import BacktestConfig, StrategyConfig, versions
from tidemark.operators import backtest, research, signals
from tidemark.plans import reports
from tidemark.sources import candles as store

BY = ("instrument",)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file through Hadoop's file systems, so any store that Spark can write to will do."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; None if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def signals_of(spark: SparkSession, processed: str, month: str, timeframe: str, config: StrategyConfig) -> DataFrame:
    return signals.generate_signals(store.read_store(spark, processed, month, timeframe), config, BY, keep=("open", "close"))


def write_signals(spark: SparkSession, processed: str, results: str, month: str, timeframe: str, config: StrategyConfig = StrategyConfig()) -> dict:
    """The signal table of a month; returns its counts."""
    path = f"{results}/{month}/signals_{timeframe}"
    save(signals_of(spark, processed, month, timeframe, config).drop("open", "close"), path)
    counts = signals.signal_counts(spark.read.parquet(path), ()).first()
    return {"BUY": counts.buys, "SELL": counts.sells, "bars": counts.bars}


def write_backtest(spark: SparkSession, processed: str, results: str, month: str, timeframe: str, config: StrategyConfig = StrategyConfig(), run: BacktestConfig = BacktestConfig()) -> list[dict]:
    """Trades, equity and metrics of a month."""
    trades, equity, found = backtest.run_backtest(signals_of(spark, processed, month, timeframe, config), run, BY)
    save(trades, f"{results}/{month}/trades_{timeframe}")
    save(equity, f"{results}/{month}/equity_{timeframe}")
    records = reports.records(found)
    write_text(spark, f"{results}/{month}/metrics_{timeframe}.json", reports.dumps(records))
    return records


def write_baseline(spark: SparkSession, processed: str, results: str, month: str, timeframes: Sequence[str], run: BacktestConfig) -> dict:
    """The comparison of variants and timeframes as JSON and Markdown, and the trades of all experiments in one table."""
    rows = store.read_store(spark, processed, month).where(F.col("tf").isin(*timeframes)).withColumnRenamed("tf", "timeframe")
    trades, found = research.run_baseline(rows, by=(*BY, "timeframe"), backtest_config=run)
    save(trades, f"{results}/{month}/baseline/trades")
    records = reports.records(found)
    digests = {v: c.digest() for v, c in research.baseline_variants()}
    assumptions = {"execution": "next bar's open", "slippage": run.slippage.mode, "lot_size": run.lot_size, "position_size": run.position_size, "initial_capital": run.initial_capital}
    experiments = [{**r, "config_hash": digests[r["variant"]]} for r in records]
    record = {"period": month, **versions(month), "experiment_count": len(records), "assumptions": assumptions, "experiments": experiments, "comparison_table": reports.comparison(records)}
    write_text(spark, f"{results}/{month}/baseline_comparison.json", reports.dumps(record))
    write_text(spark, f"{results}/{month}/baseline_report.md", reports.baseline_markdown(month, month, records, assumptions, experiments, f"{results}/{month}"))
    return record


def write_research(spark: SparkSession, tools, results: str, month: str, timeframes: Sequence[str], grid=None) -> dict:
    """Robustness results; timeframes of an earlier run stay unless they are run again."""
    import json

    path = f"{results}/{month}/research/regime_analysis.json"
    summary = tools.robustness(month, timeframes, grid)
    earlier = read_text(spark, path)
    if earlier:
        summary["timeframes"] = {**json.loads(earlier)["timeframes"], **summary["timeframes"]}
    write_text(spark, path, reports.dumps(summary))
    write_text(spark, f"{results}/{month}/research/robustness_report.md", reports.robustness_markdown(summary))
    return summary
