"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without leading and trailing ASCII white space and
with A-Z lower-cased; its hash has 128 bits. ``LineRuns`` keeps, in a folder
of the shared store, sorted runs of (hash, number of documents, first
document): tables bucketed and sorted by hash, with one number of buckets for all
levels, so that a merge join reads them without a shuffle. Each batch adds one
run at level 0; ``FANOUT`` runs of a level that follow each other without a gap
are compacted into one run of the next, so that a store of n batches holds
O(FANOUT * log n) runs and every row is rewritten O(log n) times.

*Merge-anti-join.* A line that enough documents of one run hold is closed: its
fate is settled. Each new batch is summed by line and merge-anti-joined with
the closed lines of every run; what is left is added as its run. With
``keep_first`` a closed line still goes in where the batch has an earlier
document. When all batches are in, the runs are summed, and the lines of every
document meet those that enough documents hold in a second pass, as all copies
go, those in earlier batches too. A streamed batch (``dedup_batch``) drops what
earlier batches hold: its lines are merge-anti-joined with all lines of the
runs. Sums over several runs read them as plain files: Spark 4.1.2 takes a union
of bucketed tables for co-located but reads them unbucketed, and sums wrongly.

Commits are idempotent: a run's name states its level, the first and the last
batch in it (all numbers between are in it) and its buckets; a run counts once
its writer has put ``_SUCCESS`` there, and runs that a committed run of a higher
level covers are ignored. A batch or compaction that died half way is simply run
again; a batch that comes late is added when it comes.

Defined cases: a null text is one empty line and stays null; keys shorter than ``min_chars``
code points are never dropped; every row is a document, also where its doc_id
is null or repeated. Among documents the first is the one with the least
doc_id (null last), ties by content. Very long texts are split whole, in one
worker; an empty table gives an empty result; columns named n_lines, n_dropped or
kept_sha256 (with the prefix) are replaced, others kept.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

FANOUT = 4
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"

LINES = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("doc", T.BinaryType()), T.StructField("key", T.BinaryType())])


def line_key(line: bytes) -> bytes:
    """Bytes lower() changes A-Z only."""
    return line.strip(WHITE).lower()


def doc_lines(df: DataFrame, id_col: str, text_col: str, min_chars: int = 1, batches: int = 1) -> DataFrame:
    """One row (batch, doc, key) for each distinct line key of each document."""
    schema = common.arrow_schema(LINES)

    def rows(batch):
        of, docs, keys = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), common.raw(batch.column(1)), strict=True):
            own = {xxhash.xxh3_128_digest(k) for k in map(line_key, text.split(b"\n")) if _long_enough(k, min_chars)}
            keys += own
            docs += [doc] * len(own)
            of += [doc[-1] % batches] * len(own)
        yield pa.record_batch([pa.array(of, pa.int32()), pa.array(docs, pa.binary()), pa.array(keys, pa.binary())], schema=schema)

    return common.map_arrow(df.select(common.doc_key(id_col, text_col).alias("doc"), F.col(text_col)), rows, LINES)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


class LineRuns:
    """Levelled runs of line hashes in a folder of the shared store.

    ``path`` is an existing store's folder; without it the store is a scratch
    one. ``buckets`` is taken from the runs that there are, else from the
    session's shuffle partitions.
    """

    SCHEMA = "key binary, n_docs long, first_doc binary"

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.path, self.fanout = spark, path or common.scratch(spark, "line-runs"), fanout
        held = [r[3] for r in self._runs()]
        self.buckets = held[0] if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._names: dict[tuple, str] = {}

    def _runs(self) -> list[tuple[int, int, int, int]]:
        """(level, first batch, last batch, buckets) of the committed runs that no other covers."""
        names = [n for n in common.list_names(self.spark, self.path) if n.startswith("run-") and common.exists(self.spark, f"{self.path}/{n}/_SUCCESS")]
        found = [tuple(int(x) for x in n.split("-")[1:]) for n in names]
        return sorted(r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found))

    def _at(self, run: tuple) -> str:
        return f"{self.path}/run-" + "-".join(map(str, run))

    def _table(self, run: tuple) -> DataFrame:
        """One run, known to the catalogue by its buckets and order."""
        if run not in self._names:
            name = f"tidemark_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {name} ({self.SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {run[3]} BUCKETS LOCATION '{self._at(run)}'")
            self._names[run] = name
        return self.spark.table(self._names[run])

    def close(self) -> None:
        """Takes the runs' names out of the catalogue; the files stay, and a later use finds them again."""
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names.clear()

    def _write(self, rows: DataFrame, run: tuple) -> None:
        name = f"tidemark_run_{uuid.uuid4().hex}"
        rows.write.mode("overwrite").format("parquet").bucketBy(run[3], "key").sortBy("key").option("path", self._at(run)).saveAsTable(name)
        self._names[run] = name

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        """Rows that are distinct by key as a scratch table bucketed like the runs, so that joins above need no shuffle and none is moved below the sums."""
        name, path = f"tidemark_batch_{uuid.uuid4().hex}", common.scratch(self.spark, "batch")
        rows.repartition(self.buckets, "key").write.mode("overwrite").format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        self._names[(path,)] = name
        return self.spark.table(name)

    def holds(self, batch: int) -> bool:
        return any(low <= batch <= high for _, low, high, _ in self._runs())

    def next_batch(self) -> int:
        return max((r[2] for r in self._runs()), default=-1) + 1

    def add(self, batch: int, lines: DataFrame, min_docs: int | None = None, keep_first: bool = False) -> None:
        """Commits the lines (doc, key) of batch number ``batch`` (0, 1, ...) as a run of level 0, unless that is done already, and compacts full levels.

        With ``min_docs`` lines that so many documents hold by the runs are closed and left out.
        """
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        if not self.holds(batch):
            summed = lines.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first_doc"))
            runs = self._runs() if min_docs is not None else []
            summed = self._bucketed(summed) if runs else summed.repartition(self.buckets, "key")
            for run in runs:
                closed = self._table(run).where(F.col("n_docs") >= min_docs).select(F.col("key").alias("closed"), F.col("first_doc").alias("known"))
                settled = F.col("key") == F.col("closed")
                summed = summed.join(closed.hint("merge"), settled & (F.col("known") <= F.col("first_doc")) if keep_first else settled, "left_anti")
            self._write(summed, (0, batch, batch, self.buckets))
        self.compact()

    def compact(self) -> None:
        """Merges ``fanout`` runs of a level that follow each other without a gap into one of the next level, as long as there are such."""
        while chain := self._full():
            merged = (chain[0][0] + 1, chain[0][1], chain[-1][2], self.buckets)
            self._write(self._summed(self._plain(chain).repartition(self.buckets, "key")), merged)
            for run in chain:
                if run in self._names:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(run)}")
                common.remove(self.spark, self._at(run))

    def _full(self) -> list[tuple]:
        chain: list[tuple] = []
        for run in self._runs():
            chain = [*chain, run] if chain and chain[-1][0] == run[0] and chain[-1][2] + 1 == run[1] else [run]
            if len(chain) == self.fanout:
                return chain
        return []

    def _plain(self, runs: list[tuple]) -> DataFrame:
        """The rows of several runs as plain files; see the module."""
        return self.spark.read.schema(self.SCHEMA).parquet(*map(self._at, runs))

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"))

    def totals(self) -> DataFrame:
        """(key, n_docs, first_doc) over all runs; one run is read as it is. Counts of closed lines stop where they were closed."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self._plain(runs) if len(runs) == 1 else self._summed(self._plain(runs))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The rows of ``lines`` (doc, key) whose key is in no run yet.

        Distinct keys go through the merge-anti-join, so a hot line is one row there.
        """
        fresh = self._bucketed(lines.select("key").distinct())
        for run in self._runs():
            fresh = fresh.join(self._table(run).select(F.col("key").alias("seen")).hint("merge"), F.col("key") == F.col("seen"), "left_anti")
        return lines.join(common.written(fresh, "fresh-lines").hint("merge"), "key")


def dropped(lines: DataFrame, frequent: DataFrame, keep_first: bool = False) -> DataFrame:
    """(doc, keys): the lines of each document that go, by a merge join with the frequent ones.

    Both sides are read from tables and shuffled, so that adaptive execution can
    split the partition of a line which a third of all documents hold.
    """
    hit = lines.select("doc", "key").join(frequent.hint("merge"), "key")
    hit = hit.where(F.col("doc") != F.col("first_doc")) if keep_first else hit
    return hit.groupBy("doc").agg(F.collect_set("key").alias("keys"))


def drop_lines(df: DataFrame, dropped: DataFrame, id_col: str, text_col: str, prefix: str = "", stay: int | None = None) -> DataFrame:
    """All columns of ``df``, ``text_col`` without the lines in ``dropped``, and n_lines, n_dropped and kept_sha256.

    With ``stay``, ``dropped`` lists the lines that stay instead; shorter keys than ``stay`` code points always do.

    The three get ``prefix``; columns of ``df`` with the same names are replaced.
    The text crosses one shuffle, to meet its own list of lines.
    """
    added = [prefix + n for n in ("n_lines", "n_dropped", "kept_sha256")]
    columns = [c for c in df.columns if c not in added]
    src = df.select(*columns)
    keyed = src.withColumn("__tm_doc", common.doc_key(id_col, text_col))
    joined = keyed.join(dropped.withColumnsRenamed({"doc": "__tm_doc", "keys": "__tm_keys"}).hint("merge"), "__tm_doc", "left").select(*columns, "__tm_keys")
    out = T.StructType([*src.schema.fields, *(T.StructField(n, t) for n, t in zip(added, (T.LongType(), T.LongType(), T.StringType()), strict=True))])
    schema, at = common.arrow_schema(out), columns.index(text_col)

    def rows(batch):
        texts, n_lines, n_dropped, hashes = [], [], [], []
        for text, known, keys in zip(common.raw(batch.column(at)), batch.column(at).is_valid().to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            lines = text.split(b"\n")
            listed = frozenset(keys or ())
            if stay is not None:
                kept = [x for x in lines if not _long_enough(k := line_key(x), stay) or xxhash.xxh3_128_digest(k) in listed]
            else:
                kept = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in listed] if listed else lines
            text = b"\n".join(kept) if len(kept) < len(lines) else text
            texts.append(text if known else None)
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            hashes.append(hashlib.sha256(text).hexdigest())
        arrays = list(batch.columns[:-1])
        arrays[at] = pa.array(texts, pa.binary()).cast(schema.field(at).type)
        yield pa.record_batch([*(a.cast(f.type) for a, f in zip(arrays, schema, strict=False)), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(hashes, schema.field(len(schema) - 1).type)], schema=schema)

    return common.map_arrow(joined, rows, out)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, batches: int = 4, runs: LineRuns | None = None, prefix: str = "") -> DataFrame:
    """Drops every line whose key at least ``min_docs`` documents hold; see the module for keys and defined cases.

    ``df`` is dealt into ``batches`` batches (256 at most) by content; each adds
    its run to ``runs`` before the documents are probed. ``runs`` is a fresh store
    by default; in a given one the batches get the next free numbers, and the
    documents that it has count too. ``keep_first`` leaves such a line in its
    first document. Returns the columns of ``df`` with the new text, and
    n_lines, n_dropped, kept_sha256 with ``prefix``.
    """
    spark = df.sparkSession
    with common.scope(spark):
        lines = common.written(doc_lines(df, id_col, text_col, min_chars, batches), "lines", "batch", keep=True)
        runs = runs or LineRuns(spark)
        start = runs.next_batch()
        try:
            for batch in range(batches):
                runs.add(start + batch, lines.where(F.col("batch") == batch), min_docs, keep_first)
            frequent = common.written(runs.totals().where(F.col("n_docs") >= min_docs), "frequent-lines", keep=True)
        finally:
            runs.close()
    return drop_lines(df, dropped(lines, frequent, keep_first), id_col, text_col, prefix)


def dedup_batch(runs: LineRuns, batch: int, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """Streaming form: drops the lines of ``df`` that earlier batches have, then commits its own.

    Lines repeated only within the batch stay; run again with the same number
    it commits nothing twice, but then finds its own lines in the store, so
    callers write the result before they acknowledge the batch.
    """
    with common.scope(runs.spark):
        lines = common.written(doc_lines(df, id_col, text_col, min_chars), "lines")
        try:
            fresh = runs.unseen(lines).groupBy("doc").agg(F.collect_set("key").alias("keys"))
            out = common.written(drop_lines(df, fresh, id_col, text_col, stay=min_chars), "deduplicated", keep=True)
            runs.add(batch, lines)
        finally:
            runs.close()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT r, doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each),
often AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE often.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often ON keyed.key = often.key GROUP BY r
"""
