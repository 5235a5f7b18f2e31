import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.frames import BASE, candles, session
from tidemark.operators import bars, quality


def checks(df):
    return {r["name"]: (r["status"], r["failures"]) for r in df.collect()}


def five(spark, rows, minutes=5):
    return bars.aggregate_bars(candles(spark, rows), minutes, ("instrument",))


@pytest.mark.parametrize(("minutes", "count", "last"), [(5, 75, "15:25"), (15, 25, "15:15")])
def test_session_buckets(spark, minutes, count, last):
    out = five(spark, session(), minutes).orderBy("timestamp").collect()
    assert len(out) == count and out[-1].timestamp.strftime("%H:%M") == last


def test_first_bucket_values(spark):
    r = five(spark, session()).orderBy("timestamp").first()
    assert (r.open, r.high, r.low, r.close, r.volume, r.open_interest) == (100, 105, 99, 104.5, 500, 1104)


def test_days_do_not_mix_and_rows_may_come_in_any_order(spark):
    rows = session(2)
    out = five(spark, rows[::-1]).groupBy(F.to_date("timestamp")).count().collect()
    assert [r["count"] for r in out] == [75, 75]
    whole = lambda d: sorted(map(tuple, d.collect()))
    assert whole(five(spark, rows)) == whole(bars.aggregate_bars(candles(spark, rows).repartition(7), 5, ("instrument",)))


def test_one_minute_is_identity_and_volume_is_kept(spark):
    df = candles(spark, session())
    assert bars.aggregate_bars(df, 1) is df
    assert bars.aggregate_bars(df, 15).agg(F.sum("volume")).first()[0] == 37_500


def test_rollup_of_rollup_equals_direct_rollup(spark):
    df = candles(spark, session())
    via = bars.aggregate_bars(bars.aggregate_bars(df, 5), 15)
    assert sorted(map(tuple, via.collect())) == sorted(map(tuple, bars.aggregate_bars(df, 15).collect()))


def test_verification_passes_and_sees_tampering(spark):
    df = candles(spark, session())
    good = bars.aggregate_bars(df, 5)
    assert {s for s, _ in checks(bars.verify_rollup(df, good, 5)).values()} == {"pass"}
    bad = good.withColumn("volume", F.when(F.col("timestamp") == F.lit(BASE).cast("timestamp_ntz"), F.col("volume") + 1).otherwise(F.col("volume")))
    assert checks(bars.verify_rollup(df, bad, 5))["volume_sum"] == ("fail", 1)
    odd = good.withColumn("low", F.col("high") + 1)
    assert checks(bars.verify_rollup(df, odd, 5))["ohlc_integrity"][0] == "fail"
    shifted = good.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 MINUTE"))
    found = checks(bars.verify_rollup(df, shifted, 5))
    assert found["boundary_alignment"][0] == found["edge_alignment"][0] == "fail"


def test_partial_bucket_warns(spark):
    df = candles(spark, session(1, 11))
    found = checks(bars.verify_rollup(df, bars.aggregate_bars(df, 5), 5))
    assert found["bucket_size"] == ("warn", 1) and found["volume_sum"][0] == "pass"


def validated(spark, rows, **kw):
    found = quality.validate_bars(candles(spark, rows), 1, **kw).collect()
    return {r["name"]: r["status"] for r in found}, found[0].overall if found else None


def test_clean_sessions_pass(spark):
    states, overall = validated(spark, session(2))
    assert overall == "pass" and set(states.values()) == {"pass"} and len(states) == 8


def low(rows):
    rows[3][4] = -100.0


def jump(rows):
    rows[30][7] *= 10


def overnight(rows):
    for r in rows[375:]:
        r[7] *= 3


def early(rows):
    rows.append(["NIFTY", dt.datetime(2026, 7, 1, 15, 31), 100.0, 101.0, 99.0, 100.0, 100, 1000])


def double(rows):
    rows.extend([list(r) for r in rows[:3]])


def still(rows):
    rows[5][6] = 0


def negative(rows):
    rows[5][6] = -1


def hole(rows):
    del rows[100]


@pytest.mark.parametrize(("change", "name", "status", "overall"), [
    (low, "ohlc_integrity", "fail", "fail"), (jump, "open_interest_sanity", "warn", "pass_with_warnings"), (overnight, "open_interest_sanity", "pass", "pass"), (early, "market_hours", "fail", "fail"),
    (double, "no_duplicates", "fail", "fail"), (still, "volume_sanity", "warn", "pass_with_warnings"), (negative, "volume_sanity", "fail", "fail"), (hole, "continuity", "warn", "pass_with_warnings"), (hole, "daily_bar_counts", "warn", "pass_with_warnings"),
])
def test_faults_are_found(spark, change, name, status, overall):
    states, found = validated(spark, session(2, change=change))
    assert states[name] == status and found == overall


@pytest.mark.parametrize("chunk", [3, 100_000])
def test_stored_order(spark, monkeypatch, chunk):
    monkeypatch.setattr(quality, "STORED_CHUNK", chunk)
    rows = session(1, 20)
    rows[3], rows[9] = rows[9], rows[3]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], candles(spark, rows).schema.add("ord", "long"))
    found = {r["name"]: (r["status"], r["failures"]) for r in quality.validate_bars(df, 1, place=("ord",)).collect()}
    times = [r[1] for r in rows]
    assert found["timestamp_monotonic"] == ("fail", sum(b < a for a, b in zip(times, times[1:], strict=False)))
    assert quality.stored_order(df, ("instrument", "ord"), ()).first().back == 2


def test_details_of_checks(spark):
    found = {r["name"]: r["details"] for r in quality.validate_bars(candles(spark, session(2, change=hole)), 1).collect()}
    assert found["daily_bar_counts"] == "1 day(s) with != 375 bars" and found["continuity"] == "1 intraday gaps, ~1 missing bars" and found["open_interest_sanity"] == "0 negative, 0 jumps > 25%"
    df = candles(spark, session())
    said = {r["name"]: r["details"] for r in bars.verify_rollup(df, bars.aggregate_bars(df, 5), 5).collect()}
    assert said["volume_sum"] == "1m=37500 vs 5m=37500" and said["edge_alignment"] == "first=True, last_within=True"


def test_prices_of_zero_fail_unless_they_are_allowed(spark):
    def change(rows):
        rows[2][4] = 0.0

    def broken(rows):
        rows[2][4], rows[3][3] = -1.0, 0.0

    assert validated(spark, session(1, change=change))[1] == "fail"
    states, overall = validated(spark, session(1, change=change), positive=False)
    assert states["ohlc_integrity"] == "warn" and overall == "pass_with_warnings"
    found = checks(quality.validate_bars(candles(spark, session(1, change=broken)), 1, positive=False))
    assert found["ohlc_integrity"] == ("fail", 2)


def test_null_prices_fail(spark):
    def change(rows):
        rows[2][2] = None

    assert validated(spark, session(1, change=change))[0]["ohlc_integrity"] == "fail"
