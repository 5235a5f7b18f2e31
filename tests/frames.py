"""Closed-form input frames of the tests."""

import datetime as dt
import math

BASE = dt.datetime(2026, 7, 1, 9, 15)
CANDLE = "instrument string, timestamp timestamp_ntz, open double, high double, low double, close double, volume long, open_interest long"


def session(days=1, minutes=375, change=None):
    """Bars of 09:15 to 15:29: open 100+i, high +1, low -1, close +0.5, volume 100, open interest 1000+price."""
    rows = []
    for d in range(days):
        for i in range(minutes):
            p = 100.0 + i
            rows.append(["NIFTY", BASE + dt.timedelta(days=d, minutes=i), p, p + 1, p - 1, p + 0.5, 100, 1000 + int(p)])
    if change:
        change(rows)
    return [tuple(r) for r in rows]


def candles(spark, rows):
    return spark.createDataFrame(rows, CANDLE)


def closes(spark, values, minutes=1, instrument="A"):
    rows = [(instrument, BASE + dt.timedelta(minutes=minutes * i), float(v) - 0.25, float(v) + 1, float(v) - 1, float(v), 100, 1000) for i, v in enumerate(values)]
    return candles(spark, rows)


def wave(n=200):
    return [100 + 30 * math.sin(i / 12) + 0.15 * i + 0.25 for i in range(n)]


def research_month(spark, days=31):
    rows = []
    for day in range(1, days + 1):
        for hour in range(10, 16):
            i = (day - 1) * 6 + hour - 10
            p = 100 + 25 * math.sin(i / 6) + 0.05 * i
            rows.append(("A", dt.datetime(2026, 7, day, hour), p, p + 1, p - 1, p + 0.25, 100, 1000))
    return candles(spark, rows)
