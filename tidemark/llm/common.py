"""What the training-data operators share: shared scratch tables, text normalisation, Arrow mapping."""

from __future__ import annotations

import ctypes
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests, a laptop) a local folder is made and set, which
    is right only because driver and executors are then one process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_local = threading.local()
_roots: set[str] = set()


@contextmanager
def scope(spark: SparkSession):
    """Removes, at its end and on failure, the scratch tables made inside, but for those that are kept."""
    scopes = _local.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            remove(spark, path)


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh path in the shared folder, removed with the innermost scope; with ``keep`` with the next one outside.

    What no scope removes goes when the driver's JVM ends (Hadoop's
    delete-on-exit), or with ``clear``.
    """
    root = f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"
    if root not in _roots:
        fs, at = filesystem(spark, root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _roots.add(root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    scopes = getattr(_local, "scopes", [])
    depth = len(scopes) - (2 if keep else 1)
    if depth >= 0:
        scopes[depth].append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Removes all scratch tables of this application, when its results have been written."""
    remove(spark, f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")


def written(df: DataFrame, name: str, partition_by: str | None = None, keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name, keep)
    out = df.write.mode("overwrite")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_key(id_col: str, text_col: str) -> Column:
    """25 bytes that name a row's document and sort by id, null last, then by content (null is the empty text)."""
    biased = F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    head = F.when(F.col(id_col).isNull(), "01" + "0" * 16).otherwise(F.concat(F.lit("00"), biased))
    return F.unhex(F.concat(head, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))


def id_of(key: str) -> Column:
    """The id in a document key; null where the document had none."""
    number = F.conv(F.hex(F.substring(key, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))
    return F.when(F.hex(F.substring(key, 1, 1)) == "00", number)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and Path of ``path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a folder in one step; False if ``to`` is there already."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    nothing = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(at, jvm.org.apache.hadoop.fs.Path(to), nothing)
    except Py4JJavaError as error:
        if exists(spark, to):
            return False
        raise error
    return True


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, at = filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


_SHIPPED: set[str] = set()


#: Spark's defaults for batches to Python workers, and what long texts call for.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application.

    Batches to workers are made smaller where the session has Spark's defaults:
    a batch is held by the JVM and by the worker at once, several times over.
    """
    sc = spark.sparkContext
    for name, (default, smaller) in ARROW.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, smaller)
    if sc.applicationId not in _SHIPPED:
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark_package.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(top):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)


def release() -> None:
    """Gives memory that a worker no longer uses back to the system, at the end of a task; workers live on for the next one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


SLICE_ROWS = 1000


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` with a function that turns one batch into any number of batches.

    It gets slices of SLICE_ROWS rows, so that what a worker holds beside
    Spark's own batch stays small.
    """

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                yield from rows(batch.slice(low, SLICE_ROWS))
        release()

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def strings(column: pa.Array) -> Iterator[str]:
    """The values of a string column one by one; null is the empty text."""
    for value in column:
        yield value.as_py() or ""


def raw(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column one by one, without decoding; null is the empty text."""
    yield from strings_as_bytes(column)


def strings_as_bytes(column: pa.Array) -> Iterator[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""
