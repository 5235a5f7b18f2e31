import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from tests.frames import candles, session
from tidemark.functions import calendar
from tidemark.functions.schemas import CANDLES
from tidemark.plans import reports
from tidemark.plans.tools import Tools, numbers
from tidemark.sources import candles as store
from tidemark.sources import masters
from tidemark.sources.rest import CandleSource

CONTRACT = {"instrument": "NIFTY", "security_id": "101", "exchange": "NSE", "instrument_type": "FUTIDX", "expiry": dt.date(2026, 7, 30), "lot_size": 50, "tick_size": 0.05}


@pytest.mark.parametrize(("day", "want"), [((2026, 7, 5), (2026, 7, 30)), ((2026, 2, 1), (2026, 2, 26)), ((2026, 8, 31), (2026, 8, 27)), ((2026, 12, 1), (2026, 12, 31))])
def test_last_thursday(spark, day, want):
    assert spark.range(1).select(calendar.last_thursday(F.lit(dt.date(*day))).alias("d")).first().d == dt.date(*want)


def test_epochs_and_month_helpers(spark):
    got = spark.createDataFrame([(2111423399000,), (2111423399,)], "e long").select(calendar.epoch_date(F.col("e")).alias("d")).collect()
    assert {r.d for r in got} == {dt.date(2036, 11, 27)}
    assert calendar.month_range(2026, 2) == (dt.date(2026, 2, 1), dt.date(2026, 2, 28)) and calendar.month_range(2028, 12)[1].day == 31
    assert calendar.parse_month("2026-07") == (2026, 7)
    with pytest.raises(ValueError):
        calendar.parse_month("July")


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_payloads_become_wall_time_in_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        arrays = store.from_arrays(spark, [["2026-07-01T09:15:00+05:30", 1, 2, 0.5, 1.5, 10, 7], ["2026-07-01T09:16:00+05:30", 1, 2, 0.5, 1.5, 10]]).collect()
        assert [(r.timestamp, r.open_interest) for r in arrays] == [(dt.datetime(2026, 7, 1, 9, 15), 7), (dt.datetime(2026, 7, 1, 9, 16), 0)]
        for scale in (1, 1000):
            row = {"timestamp": 1720000000 * scale, "open": 1, "high": 1, "low": 1, "close": 1, "volume": 5}
            got = store.from_records(spark, [row]).first()
            assert got.timestamp == dt.datetime(2024, 7, 3, 15, 16, 40) and got.open_interest == 0
        text = json.dumps({"data": {"candles": [["2026-07-01T09:15:00+05:30", 1, 2, 0.5, 1.5, 10, 7]]}})
        flat = store.from_json_arrays(spark.createDataFrame([(text,)], "payload string")).first()
        assert flat.timestamp == dt.datetime(2026, 7, 1, 9, 15) and flat.open_interest == 7
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_payload_that_is_no_list(spark):
    with pytest.raises(ValueError):
        store.from_records(spark, {"error": 1})
    with pytest.raises(ValueError):
        store.from_arrays(spark, "no")


def test_masters(spark, tmp_path):
    (tmp_path / "m.csv").write_text("SECURITY_ID,Trading_Symbol,UNDERLYING_SYMBOL,INSTRUMENT_TYPE,SM_EXPIRY_DATE,LOT_SIZE,TICK_SIZE\n101,NIFTY-JUL,NIFTY,FUTIDX,2026-07-30,50,0.05\n102,X,NIFTY,FUTIDX,bad,x,\n")
    rows = masters.normalise_master(masters.read_csv_master(spark, str(tmp_path / "m.csv"))).orderBy("security_id").collect()
    assert (rows[0].expiry, rows[0].lot_size, rows[0].tick_size) == (dt.date(2026, 7, 30), 50, 0.05)
    assert (rows[1].expiry, rows[1].lot_size, rows[1].tick_size) == (None, None, None)
    with gzip.open(tmp_path / "m.json.gz", "wt") as f:
        json.dump([{"Segment": "NSE_FO", "expiry": 2111423399000}, {"Segment": "NSE_EQ"}], f)
    got = masters.read_json_master(spark, str(tmp_path / "m.json.gz")).collect()
    assert {r.expiry for r in got} == {dt.date(2036, 11, 27), None} and "segment" in got[0].__fields__


def test_store_partitions_and_pages(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = store.normalise(candles(spark, session(2)).drop("instrument"), CONTRACT)
    assert [f.name for f in rows.schema] == [f.name for f in CANDLES]
    store.write_store(rows, root)
    store.write_store(rows.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 MONTH")), root)
    store.write_store(rows, root)
    assert {(r.month, r.tf): r.bars for r in store.list_months(spark, root).collect()} == {("2026-07", "1m"): 750, ("2026-08", "1m"): 750}
    got = store.read_store(spark, root, "2026-07", "1m")
    assert "PartitionFilters: [isnotnull(month" in got._jdf.queryExecution().toString()
    page = store.page(got, 2, 1).collect()
    assert [r.timestamp.minute for r in page] == [16, 17] and page[0].lot_size == 50
    with pytest.raises(ValueError):
        store.page(got, 201)


def fetch_rows(options):
    return [[f"{options['from']}T09:15:00+05:30", 1, 2, 0.5, 1.5, 10]]


def test_candle_source_reads_a_range_in_each_partition(spark):
    spark.dataSource.register(CandleSource)
    import tests.test_sources_and_tools as here

    assert here.fetch_rows({"from": "2026-07-01"})
    source = CandleSource({"client": "json:loads", "ranges": '[["2026-07-01", "2026-07-02"], ["2026-07-03", "2026-07-04"]]'})
    reader = source.reader(None)
    assert [p.value for p in reader.partitions()] == [("2026-07-01", "2026-07-02"), ("2026-07-03", "2026-07-04")]
    reader.options["client"] = "tests.test_sources_and_tools:fetch_rows"
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["2026-07-01T09:15:00+05:30", "2026-07-03T09:15:00+05:30"]


def answer(request):
    assert request.method == "GET" and request.path.startswith("/v3/historical-candle/NSE_FO%7C1/minutes/5/2026-07-")
    return 200, json.dumps({"data": {"candles": [["2026-07-01T09:15:00+05:30", 1, 2, 0.5, 1.5, 10, 7]]}})


def test_requests_and_their_answers():
    from tidemark.sources import requests

    asked = requests.intraday(101, dt.date(2026, 7, 1), dt.date(2026, 7, 31), interval="5", open_interest=False)
    assert (asked.method, asked.path) == ("POST", "/v2/charts/intraday") and asked.body == {"securityId": "101", "exchangeSegment": "NSE_FNO", "instrument": "FUTIDX", "interval": "5", "oi": "false", "fromDate": "2026-07-01", "toDate": "2026-07-31"}
    assert requests.expired_history("A|1|30-07-2026", "2026-07-01", "2026-07-30").path.endswith("/A%7C1%7C30-07-2026/1minute/2026-07-30/2026-07-01")
    assert requests.expired_contracts("NSE_INDEX|Nifty 50", dt.date(2026, 7, 30)).path.endswith("expiry_date=2026-07-30")
    assert list(requests.spans(dt.date(2026, 7, 1), dt.date(2026, 7, 31), 20)) == [(dt.date(2026, 7, 1), dt.date(2026, 7, 20)), (dt.date(2026, 7, 21), dt.date(2026, 7, 31))]
    assert requests.payload_rows(200, "") == requests.payload_rows(200, '{"data": null}') == []
    with pytest.raises(RuntimeError):
        requests.payload_rows(500, "no")


def test_masters_come_from_the_first_address_that_answers(spark):
    from tidemark.sources import requests

    answers = {"a": (503, ""), "c": (200, "SM_EXPIRY_DATE,SEM_LOT_UNITS\n2026-07-30,50\n")}

    def get(url):
        if url == "b":
            raise OSError("no route")
        return answers[url]

    rows = masters.normalise_master(masters.csv_master(spark, requests.master_text(get, ("a", "b", "c")))).collect()
    assert [(r.expiry, r.lot_size) for r in rows] == [(dt.date(2026, 7, 30), 50)]
    with pytest.raises(RuntimeError):
        requests.master_text(get, ("a", "b"))


def test_candle_source_builds_requests():
    reader = CandleSource({"client": "tests.test_sources_and_tools:answer", "kind": "history", "key": "NSE_FO|1", "request": '{"interval": 5}', "from": "2026-07-01", "to": "2026-07-10", "days": "7"}).reader(None)
    assert [p.value for p in reader.partitions()] == [("2026-07-01", "2026-07-07"), ("2026-07-08", "2026-07-10")]
    assert [r[-1] for p in reader.partitions() for r in reader.read(p)] == [7, 7]


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tools")
    rows = []
    for day in (1, 2, 3, 6, 7, 8, 9, 10, 13, 14, 15, 16, 17, 20, 21, 22, 23, 24, 27, 28, 29, 30, 31):
        for i in range(375):
            p = 100 + day + 5 * ((i // 25) % 2) + 0.01 * i
            rows.append((dt.datetime(2026, 7, day, 9, 15) + dt.timedelta(minutes=i), p, p + 0.05, p - 0.05, p + 0.01, 100, 1474))
    raw = spark.createDataFrame(rows, "timestamp timestamp_ntz, open double, high double, low double, close double, volume long, open_interest long")
    store.write_store(store.normalise(raw, CONTRACT), str(top / "raw"))
    made = Tools(spark, str(top / "raw"), str(top / "processed"))
    made.report = made.process_month_data("2026-07")
    return made


def test_processing_and_listing(tools):
    assert tools.report["validation"] == "pass" and tools.report["verification"] == {"5m": "pass", "15m": "pass"}
    assert tools.list_research_months()["months"]["2026-07"] == {"1m": 8625, "5m": 1725, "15m": 575}
    assert tools.validate_dataset("2026-07")["overall_status"] == "pass"
    got = tools.get_historical_candles("2026-07", "15m", 2, 1)
    assert got["bars"] == 575 and got["preview"][0]["timestamp"] == "2026-07-01T09:30:00" and "ema_9" in got["columns"]
    json.dumps(got)


@pytest.mark.parametrize("call", [lambda t: t.get_historical_candles("2026-07", "2m"), lambda t: t.get_historical_candles("2026-07", "1m", 0), lambda t: t.get_historical_candles("2026-07", "15m", 10, 9999), lambda t: t.get_historical_candles("2026-06"), lambda t: t.generate_signal("2026-07", count=101),
                                  lambda t: t.generate_signal("2026-07", signal_mode="x"), lambda t: t.compare_timeframes("2026-07", "1,7"), lambda t: t.parameter_search("2026-07", top_n=0), lambda t: t.run_backtest_signals("2026-07", slippage="x"), lambda t: numbers(" ,")])
def test_bad_requests(tools, call):
    with pytest.raises(ValueError):
        call(tools)


def test_signals_backtest_and_comparison(tools):
    got = tools.generate_signal("2026-07", "5m", signal_mode="crossover", count=5)
    assert len(got["recent_events"]) == 5 and got["counts"]["BUY"] > 0 and got["bars"] == 1725
    run = tools.run_backtest_signals("2026-07", "5m", signal_mode="crossover", include_trades=True)
    assert run["metrics"][0]["total_trades"] == len(run["trades"]) or len(run["trades"]) == 300
    table = tools.compare_timeframes("2026-07", "5,15")
    assert table["experiment_count"] == 6 and table["comparison_table"]["A"]["5m"]["net_pnl"] == pytest.approx(run["metrics"][0]["net_pnl"])
    text = reports.baseline_markdown("2026-07", "d", [{"variant": e["variant"], "timeframe": e["timeframe"], **e["metrics"]} for e in table["experiments"]], {"slippage": "1 tick"})
    assert "| **net_pnl** |" in text and "C 15m" in text


def test_search_walk_and_report(tools):
    found = tools.parameter_search("2026-07", "15m", "5,9", "15,21", "20,30", "1,2", 3)
    assert found["combinations"] == 16 and len(found["top"]) == 3 and found["train_window"][1] == "2026-07-24T00:00:00"
    walk = tools.walk_forward_test("2026-07", "15m", "5,9", "15", "20", "1")
    assert walk["summary"]["steps_count"] == 3 and walk["summary"]["oos_total_net_pnl"] == pytest.approx(sum(s["test_net_pnl"] for s in walk["steps"]))
    text = reports.robustness_markdown(tools.robustness("2026-07", ("15m",), {"fast_ema": (5,), "slow_ema": (15,), "angle_threshold": (20.0,), "angle_lookback": (1,)}))
    assert "## 15m" in text and "| high |" in text and "- train: 2026-07-01 to 2026-07-24" in text and "5 / 15 / 20.0 / 1" in text and "## Reproducibility" in text and "profit factor" in text


def test_a_failing_month_is_not_processed(spark, tmp_path):
    from tidemark.plans import month

    def low(rows):
        rows[3][4] = -100.0

    store.write_store(store.normalise(candles(spark, session(1, change=low)).drop("instrument"), CONTRACT), str(tmp_path / "raw"))
    with pytest.raises(RuntimeError):
        month.process_month(spark, str(tmp_path / "raw"), str(tmp_path / "out"), "2026-07")
    with pytest.raises(FileNotFoundError):
        month.process_month(spark, str(tmp_path / "raw"), str(tmp_path / "out"), "2025-01")


def test_files_that_are_not_in_order_of_time_are_seen(spark, tmp_path):
    from tidemark.plans import month

    rows = store.normalise(candles(spark, session(1)).drop("instrument"), CONTRACT)
    store.write_store(rows.orderBy(F.desc("timestamp")), str(tmp_path / "good"))
    assert month.validate_month(spark, str(tmp_path / "good"), "2026-07")["overall_status"] == "pass"
    rows.coalesce(1).orderBy(F.minute("timestamp")).write.parquet(str(tmp_path / "bad" / "month=2026-07" / "tf=1m"))
    report = month.validate_month(spark, str(tmp_path / "bad"), "2026-07")
    assert report["overall_status"] == "fail" and report["errors"][0].startswith("timestamp_monotonic")


def test_download_with_a_given_client(spark, tmp_path):
    made = Tools(spark, str(tmp_path / "raw"), str(tmp_path / "p"))
    out = made.download_month_data("2026-07", CONTRACT, lambda i, a, b: [[f"{a}T09:15:00+05:30", 1, 2, 0.5, 1.5, 10, 3]])
    assert out["bars"] == 1


@pytest.mark.parametrize(("metric", "number", "text"), [("win_rate", 0.123, "12.3%"), ("net_pnl", -18672.4, "-18,672"), ("sharpe", 0.954, "0.95"), ("sharpe", None, "-")])
def test_shown(metric, number, text):
    assert reports.shown(metric, number) == text


def test_command_line_writes_results(spark, tools, tmp_path):
    from tidemark.__main__ import run
    from tidemark.plans import outputs

    roots = ["--raw", tools.raw_root, "--processed", tools.processed_root, "--results", str(tmp_path), "--timeframes", "15"]
    counts = run(spark, ["signals", "2026-07", *roots, "--mode", "crossover"])
    assert counts["15m"]["bars"] == 575 and counts["15m"]["BUY"] > 0
    found = run(spark, ["backtest", "2026-07", *roots, "--mode", "crossover", "--slippage", "normal"])["15m"][0]
    assert spark.read.parquet(f"{tmp_path}/2026-07/trades_15m").count() == found["total_trades"]
    assert json.loads(outputs.read_text(spark, f"{tmp_path}/2026-07/metrics_15m.json"))[0]["net_pnl"] == found["net_pnl"]
    table = run(spark, ["baseline", "2026-07", *roots])
    written = outputs.read_text(spark, f"{tmp_path}/2026-07/baseline_report.md")
    assert "## Reproducibility" in written and "config sha256:" in written and "cost_model_version: india_futures_v1" in written
    assert set(table) == {"A", "B", "C"} and outputs.read_text(spark, f"{tmp_path}/2026-07/baseline_report.md").startswith("# Baseline")
    small = {"fast_ema": (5,), "slow_ema": (15,), "angle_threshold": (20.0,), "angle_lookback": (1,)}
    outputs.write_research(spark, tools, str(tmp_path), "2026-07", ["15m"], small)
    again = outputs.write_research(spark, tools, str(tmp_path), "2026-07", ["5m"], small)
    assert set(again["timeframes"]) == {"5m", "15m"} and outputs.read_text(spark, f"{tmp_path}/none") is None


def test_command_line_downloads(spark, tmp_path):
    from tidemark.__main__ import run

    got = run(spark, ["download", "2026-07", "--raw", str(tmp_path / "raw"), "--client", "tests.test_sources_and_tools:client", "--contract", json.dumps({**CONTRACT, "expiry": "2026-07-30"})])
    assert got["bars"] == 1


def client(security_id, first, last):
    return fetch_rows({"from": first})
