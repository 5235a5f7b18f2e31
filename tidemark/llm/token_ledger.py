"""Token counts as delta-maintained rollups.

Changes are signed rows (source, lang, tokenizer, sign, n_tokens): an insert
is +1, a delete -1, a revised count a -1 with the old value and a +1 with the
new one. A batch is summed to one row for each key, which is what its commit
holds, so totals are additive and a batch is small whatever its size. Sums are
partial before the shuffle; a source with a third of all rows is one row of
each task.

A batch number is committed at most once: its sums are written aside and moved to
the batch's name, which fails if that is taken, so of two writers of one batch one
commits; a batch that died half way is written again when it comes again.
Compaction folds the batches up to a number into a snapshot whose name says how
far it reaches. What a snapshot covers is removed by the compaction after it, so
totals read before a compaction can still be run.

Defined cases: very long texts are counted whole; columns other than the keys and
the text take no part, whatever their names; repeated rows count each; an empty
ledger has no totals; null source, language or tokenizer is a key of its own; null
text has no tokens; a key whose documents sum to zero vanishes from the totals,
unless its tokens don't.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe, common

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenLedger:
    """Committed batches and snapshots in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or common.scratch(spark, "token-ledger")

    def _committed(self, kind: str) -> list[int]:
        names = [n for n in common.list_names(self.spark, self.path) if n.startswith(f"{kind}-")]
        return sorted(int(n.split("-")[1]) for n in names if common.exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def _state(self) -> tuple[int, list[int]]:
        """How far the newest snapshot reaches (-1 if none) and the batches after it."""
        upto = max(self._committed("snapshot"), default=-1)
        return upto, [b for b in self._committed("batch") if b > upto]

    def holds(self, batch: int) -> bool:
        upto, after = self._state()
        return batch <= upto or batch in after

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Adds the signed rows of batch ``batch`` (0, 1, ...); False if it is there already."""
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        if self.holds(batch):
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        return self._publish(summed, f"batch-{batch}")

    def _publish(self, rows: DataFrame, name: str) -> bool:
        """Writes ``rows`` aside and moves them to ``name``; False if that has been taken meanwhile."""
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        moved = common.move(self.spark, aside, f"{self.path}/{name}")
        if not moved:
            common.remove(self.spark, aside)
        return moved

    def _sum(self, upto: int, after: list[int]) -> DataFrame:
        paths = [f"{self.path}/snapshot-{upto}"] * (upto >= 0) + [f"{self.path}/batch-{b}" for b in after]
        if not paths:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.schema(TOTALS).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sum(*self._state())

    def compact(self) -> None:
        """Folds the batches that follow the snapshot without a gap into a new one, and removes what the old one covers."""
        upto, after = self._state()
        run = [b for i, b in enumerate(after) if b == upto + 1 + i]
        if not run:
            return
        covered = [f"batch-{b}" for b in self._committed("batch") if b <= upto] + [f"snapshot-{b}" for b in self._committed("snapshot") if b < upto]
        self._publish(self._sum(upto, run), f"snapshot-{run[-1]}")
        for name in covered:
            common.remove(self.spark, f"{self.path}/{name}")


def counted(df: DataFrame, vocabularies: dict[str, str], pattern: str, text_col: str = "text") -> DataFrame:
    """(source, lang, n_bytes and one count for each tokenizer) of every row; lang and source as they are."""
    out = T.StructType([T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_bytes", T.LongType()), *(T.StructField(n, T.LongType()) for n in vocabularies)])
    schema = common.arrow_schema(out)

    def rows(batch):
        texts = list(common.strings(batch.column(2)))
        counts = [[len(bpe.tree_bpe(path, pattern).encode(t)) for t in texts] for path in vocabularies.values()]
        yield pa.record_batch([batch.column(0).cast(schema.field(0).type), batch.column(1).cast(schema.field(1).type), pa.array([len(t.encode()) for t in texts], pa.int64()), *(pa.array(c, pa.int64()) for c in counts)], schema=schema)

    return common.map_arrow(df.select("source", "lang", text_col), rows, out)


def signed(rows: DataFrame, tokenizer: str, sign: int, n_tokens) -> DataFrame:
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(sign).alias("sign"), n_tokens.cast("long").alias("n_tokens"))


def versions() -> tuple[dict[str, str], str]:
    import public_tokenizers

    return {n: public_tokenizers.path(f"{n}.tiktoken") for n in ("byte_bpe_50k", "byte_bpe_multi_50k")}, public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all documents: a provisional count at ingest, then the revised, exact counts; the second batch arrives twice."""
    vocabularies, pattern = versions()
    docs = common.table(spark, sf_dir, "documents").select("source", "lang", "text")
    estimate = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4)
    ledger = TokenLedger(spark)
    ledger.commit(0, signed(docs.select("source", "lang", estimate.alias("n")), "estimate", 1, F.col("n")))
    exact = counted(docs, vocabularies, pattern)
    each = F.array(F.struct(F.lit("estimate").alias("t"), F.lit(-1).alias("s"), F.ceil(F.col("n_bytes") / 4).alias("n")), *(F.struct(F.lit(v).alias("t"), F.lit(1).alias("s"), F.col(v).alias("n")) for v in vocabularies))
    revised = exact.select("source", "lang", F.explode(each).alias("c")).select("source", "lang", F.col("c.t").alias("tokenizer"), F.col("c.s").alias("sign"), F.col("c.n").alias("n_tokens"))
    ledger.commit(1, revised)
    ledger.commit(1, revised)
    ledger.compact()
    return ledger.totals()
