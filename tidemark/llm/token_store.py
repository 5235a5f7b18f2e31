"""Token ids in ORC files, ordered by document id.

Files hold (doc_id, position, n_tokens, ids): ``position`` counts the ids
before the document in its file, ``ids`` is an array of integers that ORC
stores with its integer run-length encoding. Rows are dealt by range and sorted,
so the files in order of their numbers, and the stripes and row groups within
them, follow doc_id: stripe statistics and row indexes prune a lookup to the
stripes that can hold an id, Bloom filters on doc_id settle absent ids, and
readers split files at stripes.

Ids are those of the tokenizers library with add_special_tokens=False, behind a
worker's table of known chunks (``chunk_table``, which says why they are the same).

Defined cases: null text is empty and holds the end id alone; null doc_id
comes first; documents with the same doc_id follow each other in order of the
hash of their text, then the text, and are spread by that hash, so that one
frequent id is not one task; a special token's string in a text is that token;
a very long text is a batch of its own, worked in spans of bounded size (one
unbroken run without any safe border is encoded by the library as it is); other
columns are not stored; an empty table gives files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import chunk_table, common

STORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("position", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
ORC = {"orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "zstd"}

BATCH_BYTES = 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts) of a string column without copying texts one by one; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), starts


def _slices(starts: np.ndarray):
    """Ranges of texts of about BATCH_BYTES each; a longer text is alone."""
    low, n = 0, len(starts) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + BATCH_BYTES, side="right")) - 1)
        yield low, min(high, n)
        low = high


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, options: dict | None = None) -> None:
    """Encodes every text, appends ``end_id`` and writes the files at ``path``."""
    tokenizer = tokenizer or default_tokenizer()
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = src.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    schema = common.arrow_schema(STORED)

    def rows(batches):
        table, position = chunk_table.chunk_table(tokenizer), 0
        for batch in batches:
            data, starts = byte_texts(batch.column(1))
            for low, high in _slices(starts):
                own = starts[low : high + 1]
                ids, sizes = table.encode(data[own[0] : own[-1]], own - own[0])
                flat = np.insert(ids.astype(np.int32), np.cumsum(sizes), end_id)
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat, pa.int32())).cast(schema.field("ids").type)
                yield pa.record_batch([batch.column(0)[low:high], pa.array(position + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), lists], schema=schema)
                position += int(ends[-1])

    common.ship(df.sparkSession)
    ordered.mapInArrow(rows, STORED).write.mode("overwrite").options(**ORC | (options or {})).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows and ``start``, the number of ids in all documents before.

    Totals of the files (one small row for each) are summed on the driver.
    """
    rows = spark.read.schema(STORED).orc(path).withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long"))
    totals = sorted(rows.groupBy("file").agg(F.max(F.col("position") + F.col("n_tokens"))).collect())
    bases, before = [], 0
    for file, total in totals:
        bases.append((file, before))
        before += total
    known = spark.createDataFrame(bases, "file long, base long")
    return rows.join(F.broadcast(known), "file").withColumn("start", F.col("base") + F.col("position")).drop("file", "base", "position")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups that cannot hold them are skipped."""
    return spark.read.schema(STORED).orc(path).where(F.col("doc_id").isin(*doc_ids))


def checksums(stored: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of ``read_tokens`` rows."""
    out = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    schema = common.arrow_schema(out)

    def rows(batch):
        lists = batch.column(3)
        ends = np.asarray(lists.offsets)
        flat, ends = np.asarray(lists.flatten()).astype("<u4", copy=False), ends - ends[0]
        crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ends[1:] - ends[:-1], pa.int64()), pa.array(crcs, pa.int64())], schema=schema)

    return common.map_arrow(stored.select("doc_id", "start", "n_tokens", "ids"), rows, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "token-files")
    write_tokens(common.table(spark, sf_dir, "documents"), path)
    return checksums(read_tokens(spark, path))
