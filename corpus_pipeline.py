"""A corpus pipeline of five stages, each one operator of ``tidemark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's documents. All but the last
return the columns of documents.

Defined cases, in every stage: a null text is the empty text and stays null; texts
are whole however long; a document without words is clean, has no line that
goes and is a near copy of the others without words; rows with equal doc_id and
text are one document from the near-copy stage on; columns beyond those of
documents pass through the filters, whatever their names; an empty table gives
an empty result; without labels no document is toxic, without benchmark none
goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, decontaminate, line_dedup, ngram_join, toxicity


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    model = toxicity.fit(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold stay in the first of them only.

    A document of which nothing but white space is left, though it had text,
    is all repetition and goes; n_chars follows the new text.
    """
    seen = line_dedup.dedup_lines(docs, min_docs=10, keep_first=True, prefix="__tm_")
    left = seen.where((F.col("__tm_n_dropped") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    chars = F.when(F.col("__tm_n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars).select(*docs.columns)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word similarity of 0.8 or more the first stays."""
    return ngram_join.keep_first(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain 0.8 or more of a benchmark item go."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their token ids, checked by decoding them."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), checked=True)
    return ids.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_lines),
    ("ngram_join", remove_near_copies),
    ("decontamination", remove_benchmark),
    ("bpe", tokenise),
]

#: None: toxicity is learned and BPE needs a vocabulary; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; scratch tables go with their stage, the stages' tables with the last one."""
    docs = common.table(spark, sf_dir, "documents")
    *first, (last, final) = STAGES
    with common.scope(spark):
        for name, stage in first:
            with common.scope(spark):
                docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        return common.written(final(spark, docs, sf_dir), f"pipeline-{last}", keep=True)
