"""Connected components of an edge table by alternating large and small stars.

Each round reads and writes tables in the shared folder; no list of nodes or
edges comes to the driver, and a node with very many neighbours is met by a
join whose sides are both plain shuffles, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common


def _star(pairs: DataFrame, name: str) -> DataFrame:
    """For (u, v): links each v, and u itself, to the least of u and its neighbours."""
    least = common.written(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    return pairs.hint("merge").join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Self-loops and repeated edges are allowed; no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    with common.scope(e.sparkSession):
        return common.written(_labelled(common.written(e, "edges")), "components", keep=True)


def _labelled(e: DataFrame) -> DataFrame:
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = common.written(large, "large")
        small = _star(large, "small")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = common.written(small, "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
