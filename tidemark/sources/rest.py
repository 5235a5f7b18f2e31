"""A batch data source for candle services, with an injectable client.

``client`` is a dotted name of a function (options) -> rows on the workers, so
that one partition fetches one date range and nothing passes through the driver.
With the option ``kind`` (see ``requests.KINDS``) it is a function (Request) ->
(status, text) instead: the request is built from the options and the answer
is read here.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources import requests


class CandleSource(DataSource):
    """``spark.read.format("tidemark_candles")``: options client ("module:function"), ranges (JSON list of [from, to])
    or from, to and days (at most so many days a request); with kind also key and request (JSON of its further arguments)."""

    @classmethod
    def name(cls):
        return "tidemark_candles"

    def schema(self):
        return "iso string, open double, high double, low double, close double, volume long, open_interest long"

    def reader(self, schema):
        return CandleReader(self.options)


class CandleReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        if "ranges" in self.options:
            return [InputPartition(tuple(r)) for r in json.loads(self.options["ranges"])]
        first, last = (dt.date.fromisoformat(self.options[n]) for n in ("from", "to"))
        return [InputPartition((a.isoformat(), b.isoformat())) for a, b in requests.spans(first, last, int(self.options.get("days", "30")))]

    def read(self, partition):
        module, name = self.options["client"].split(":")
        fetch = getattr(importlib.import_module(module), name)
        first, last = partition.value
        if "kind" in self.options:
            request = requests.KINDS[self.options["kind"]](self.options["key"], first, last, **json.loads(self.options.get("request", "{}")))
            rows = requests.payload_rows(*fetch(request))
        else:
            rows = fetch({**self.options, "from": first, "to": last})
        for row in rows:
            interest = int(row[6]) if len(row) > 6 and row[6] is not None else 0
            yield (str(row[0]), float(row[1]), float(row[2]), float(row[3]), float(row[4]), int(row[5]), interest)
