import pytest
from pyspark.sql import functions as F

from tidemark.llm import common


def test_document_keys_sort_by_id_and_tell_nulls_apart(spark):
    ids = [-(2**63), -5, 0, 7, 2**63 - 1, None]
    rows = [(i, t) for i in ids for t in ("a", "", None, "é" * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", common.doc_key("doc_id", "text"))
    got = df.withColumn("back", common.id_of("key")).collect()
    assert all(r.back == r.doc_id and len(r.key) == 25 for r in got)
    assert len({bytes(r.key) for r in got}) == 3 * len(ids)
    order = [r.doc_id for r in sorted(got, key=lambda r: bytes(r.key))]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))


def test_scopes_remove_what_is_not_kept(spark):
    df = spark.range(3)
    path = lambda frame: frame.inputFiles()[0].rsplit("/", 1)[0]
    with common.scope(spark):
        with common.scope(spark):
            inner, kept = path(common.written(df, "inner")), path(common.written(df, "kept", keep=True))
        assert not common.exists(spark, inner) and common.exists(spark, kept)
        outlives = path(common.written(df, "outlives", keep=True))
    assert not common.exists(spark, kept) and common.exists(spark, outlives)
    with pytest.raises(ZeroDivisionError), common.scope(spark):
        failed = path(common.written(df, "failed"))
        1 / 0
    assert not common.exists(spark, failed)


def test_move_is_refused_where_the_name_is_taken(spark):
    a, b = common.scratch(spark, "a"), common.scratch(spark, "b")
    spark.range(2).write.parquet(a)
    assert common.move(spark, a, b) and spark.read.parquet(b).count() == 2
    spark.range(5).write.parquet(a)
    assert not common.move(spark, a, b) and spark.read.parquet(b).count() == 2 and common.exists(spark, a)
    with pytest.raises(Exception):
        common.move(spark, a + "-none", b + "-other")


def test_clear_removes_all_scratch(spark):
    path = common.scratch(spark, "left")
    spark.range(1).write.parquet(path)
    common.clear(spark)
    assert not common.exists(spark, path)
    assert common.written(spark.range(4).where(F.col("id") > 1), "again").count() == 2
