"""A streaming tick source with an injectable client, heartbeats and topic sinks."""

from __future__ import annotations

import importlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import DataStreamWriter

from tidemark.streaming import bars


class TickSource(DataSource):
    """``spark.readStream.format("tidemark_ticks")``: JSON envelopes (``bars.ENVELOPE``) of a client.

    ``client`` is "module:function", (options, position) -> (envelopes, next
    position): positions start at 0, are the stream's offsets, and asked again
    must give the same envelopes, so a failed batch is read again whole.
    """

    @classmethod
    def name(cls):
        return "tidemark_ticks"

    def schema(self):
        return "value string"

    def simpleStreamReader(self, schema):
        return TickReader(self.options)


class TickReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.options = dict(options)

    def _fetch(self, position):
        module, name = self.options["client"].split(":")
        return getattr(importlib.import_module(module), name)(self.options, position)

    def initialOffset(self):
        return {"position": int(self.options.get("position", "0"))}

    def read(self, start):
        found, position = self._fetch(start["position"])
        return iter([(x if isinstance(x, str) else json.dumps(x),) for x in found]), {"position": position}

    def readBetweenOffsets(self, start, end):
        position, rows = start["position"], []
        while position < end["position"]:
            found, position = self._fetch(position)
            rows += [(x if isinstance(x, str) else json.dumps(x),) for x in found]
        return iter(rows)


def heartbeats(messages: DataFrame, seconds: int = 30, column: str = "value") -> DataFrame:
    """(source, at, events): events of each source by window of event time; a source's silence is a window that does not come."""
    event = F.from_json(F.col(column).cast("string"), bars.ENVELOPE)
    rows = messages.select(event.alias("e")).where("e.ts IS NOT NULL").select("e.source", "e.ts")
    counted = rows.withWatermark("ts", f"{2 * seconds} seconds").groupBy("source", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("events"))
    return counted.select("source", F.to_timestamp_ntz(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss")).alias("at"), "events")


def to_topic(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """A writer of (key, value) messages, as ``bars.envelope`` makes them, to a topic; start it."""
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint}
    return messages.writeStream.format("kafka").options(**options).outputMode("append")
