"""Exact top-k search by inner product with a vector-approximation file.

Two tables are written: the exact vectors (integers floor(scale * x), as
doubles) under a row key, and the approximations under the same key, one byte
for each dimension: the number of the cell that the component falls into. Cell
borders are fitted for each length and dimension: the least and greatest
component of all rows outside, quantiles of about FIT_ROWS rows inside (those of
least hash; fitting sets how tight bounds are, never what is found).

For a query q and a vector whose cells have middles m and half widths h, the
score lies within q.m +- |q|.h. *Scan.* Each task reads approximations only, keeps
the k highest lower bounds of each query, and returns the rows whose upper bound
reaches the kth of them; over all tasks only rows remain whose upper bound
reaches the kth lower bound of all. *Reads.* Exact vectors are then read in order
of the upper bounds, in two steps: the first 2k of each query give a kth exact
score, and of the rest only those are read whose upper bound reaches it. What is
not read cannot be among the k, ties included.

The queries are a stated set. They go to the tasks in blocks of at most
QUERY_BLOCK queries and QUERY_BYTES; each block takes one scan of the
approximations and two joins of its candidates with the exact table, and its
results are written to the shared folder, so neither driver nor broadcast
grows with the number of queries.

Defined cases: vectors that are null, empty, or hold a null or non-finite
component take no part; neither do rows without id. A query's candidates are
the vectors of its length. Repeated ids are candidates each, but one query
(the least vector); a query's own id is never its candidate. Any finite component
is allowed: one beyond the doubles after scaling counts as the greatest double,
scores are exact integers, and one beyond a long counts as the nearest long.
Other columns take no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm import common

BITS = 8
FIT_ROWS = 4096
QUERY_BLOCK, QUERY_BYTES = 8192, 8 << 20
QUERY_SLICE, ROW_SLICE = 256, 2048
HELD = 200_000
LONG = 2.0**63
GREATEST = np.finfo(np.float64).max


def _struct(spec: str) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "binary": T.BinaryType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (part.split() for part in spec.split(", "))])


EXACT = _struct("vec_id long, dim int, exact binary")
EDGES = _struct("dim int, low binary, high binary")
BORDERS = _struct("dim int, borders binary")
CELLS = _struct("key long, vec_id long, dim int, cells binary")
BOUNDS = _struct("query_id long, key long, lower double, upper double")
SCORES = _struct("query_id long, vec_id long, score long")


def exact_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(vec_id, dim, exact) of every row that takes part: floor(scale * x) as packed doubles."""
    schema = common.arrow_schema(EXACT)
    src = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    src = src.where((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))

    def rows(batch):
        lists = batch.column(1)
        offsets = np.asarray(lists.offsets)
        flat, offsets = np.asarray(lists.flatten()), (offsets - offsets[0]).tolist()
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(scale * flat), -GREATEST, GREATEST).astype("<f8")
        cuts = list(zip(offsets[:-1], offsets[1:], strict=True))
        yield pa.record_batch([batch.column(0), pa.array([b - a for a, b in cuts], pa.int32()), pa.array([whole[a:b].tobytes() for a, b in cuts], pa.binary())], schema=schema)

    return common.map_arrow(src, rows, EXACT)


def _by_length(dims: np.ndarray, packed: list[bytes], kind: str):
    """(rows, matrix) of the packed vectors of each length."""
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield at, np.frombuffer(b"".join(packed[i] for i in at), kind).reshape(len(at), -1)


def fitted_borders(exact: DataFrame, bits: int = BITS) -> dict[int, np.ndarray]:
    """For each length the borders of the cells, (dim, 2**bits + 1); they hold every vector."""
    edge_schema, schema = common.arrow_schema(EDGES), common.arrow_schema(BORDERS)
    total = max(exact.count(), 1)

    def edges(batches):
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for _, m in _by_length(batch.column(0).to_numpy(), batch.column(1).to_pylist(), "<f8"):
                low, high = seen.get(m.shape[1], (m[0], m[0]))
                seen[m.shape[1]] = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
        yield pa.record_batch([pa.array(list(seen), pa.int32()), *(pa.array([x[i].tobytes() for x in seen.values()], pa.binary()) for i in (0, 1))], schema=edge_schema)

    def fit(key, part):
        low, high = (np.stack([np.frombuffer(x, "<f8") for x in part.column(n).to_pylist()]) for n in ("low", "high"))
        inner = np.quantile(low, np.arange(1, 2**bits) / 2**bits, axis=0, method="inverted_cdf")
        borders = np.concatenate((low.min(axis=0)[None, :], inner, high.max(axis=0)[None, :])).T
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([borders.tobytes()], pa.binary())], schema=schema)

    common.ship(exact.sparkSession)
    outer = exact.select("dim", "exact").mapInArrow(edges, EDGES)
    chosen = F.pmod(F.xxhash64("vec_id", "exact", F.lit("fit")), F.lit(total)) < FIT_ROWS
    sample = exact.where(chosen).select("dim", F.col("exact").alias("low"), F.col("exact").alias("high"))
    found = outer.unionByName(sample).groupBy("dim").applyInArrow(fit, BORDERS).collect()
    return {r.dim: np.frombuffer(r.borders, "<f8").reshape(r.dim, -1) for r in found}


def approximations(exact: DataFrame, borders: dict[int, np.ndarray]) -> DataFrame:
    """(key, vec_id, dim, cells): the cell of each component, one byte each."""
    schema = common.arrow_schema(CELLS)

    def rows(batch):
        packed, out = batch.column(3).to_pylist(), [b""] * batch.num_rows
        for at, m in _by_length(batch.column(2).to_numpy(), packed, "<f8"):
            inner = borders[m.shape[1]][:, 1:-1]
            cells = np.stack([np.searchsorted(inner[d], m[:, d], side="right") for d in range(m.shape[1])], axis=1).astype(np.uint8)
            for i, row in zip(at.tolist(), cells, strict=True):
                out[i] = row.tobytes()
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], schema=schema)

    return common.map_arrow(exact.select("key", "vec_id", "dim", "exact"), rows, CELLS)


class Scan:
    """The bounds of one length's queries over batches of approximations; ``known`` is the kth highest lower bound so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, borders: np.ndarray, k: int):
        self.ids, self.queries, self.size, self.k = ids, queries, np.abs(queries), k
        # components are integers, so a cell ends one below the next one's border
        low = borders[:, :-1]
        high = np.maximum(low, np.concatenate((borders[:, 1:-1] - 1, borders[:, -1:]), axis=1))
        self.middle, self.half = low / 2 + high / 2, high / 2 - low / 2
        self.best = np.full((len(ids), k), -np.inf)
        self.order = np.argsort(ids)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, keys: np.ndarray, vec_ids: np.ndarray, cells: np.ndarray) -> None:
        places = np.arange(cells.shape[1])
        middle, half = self.middle[places, cells], self.half[places, cells]
        at = np.minimum(np.searchsorted(self.ids, vec_ids, sorter=self.order), len(self.ids) - 1)
        owner = np.where(self.ids[self.order[at]] == vec_ids, self.order[at], -1)
        for low in range(0, len(self.ids), QUERY_SLICE):
            part = slice(low, low + QUERY_SLICE)
            with np.errstate(over="ignore", invalid="ignore"):
                centre, spread = self.queries[part] @ middle.T, self.size[part] @ half.T
                spread = spread + 1e-9 * (self.size[part] @ (np.abs(middle) + half).T) + 1e-9
                upper, lower = np.clip(centre + spread, -LONG, LONG), np.clip(centre - spread, -LONG, LONG)
            upper[np.isnan(upper)], lower[np.isnan(lower)] = LONG, -LONG
            own = np.flatnonzero((owner >= low) & (owner < low + QUERY_SLICE))
            upper[owner[own] - low, own] = lower[owner[own] - low, own] = -np.inf
            both = np.concatenate((self.best[part], lower), axis=1)
            self.best[part] = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
            q, row = np.nonzero((upper >= self.best[part].min(axis=1)[:, None]) & (upper > -np.inf))
            self.found.append((q + low, keys[row], lower[q, row], upper[q, row]))
            self.held += len(q)
        if self.held > HELD:
            self._settle()

    def _settle(self) -> None:
        """Drops what the kth lower bound has overtaken."""
        q, key, lower, upper = (np.concatenate(x) for x in zip(*self.found, strict=True))
        stay = upper >= self.best.min(axis=1)[q]
        self.found = [(q[stay], key[stay], lower[stay], upper[stay])]
        self.held = int(stay.sum())

    def results(self) -> tuple[np.ndarray, ...]:
        if not self.found:
            return tuple(np.empty(0) for _ in range(4))
        self._settle()
        q, key, lower, upper = self.found[0]
        return self.ids[q], key, lower, upper


def _scanned(cells: DataFrame, block, borders, k: int) -> DataFrame:
    """BOUNDS rows that can be among the k best of a block's queries, by the approximations alone."""
    schema = common.arrow_schema(BOUNDS)

    def rows(batches):
        scans = {dim: Scan(ids, vectors, borders.value[dim], k) for dim, (ids, vectors) in block.value.items()}
        for batch in batches:
            keys, vec_ids, packed = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            for at, m in _by_length(batch.column(2).to_numpy(), packed, np.uint8):
                if m.shape[1] in scans:
                    for low in range(0, len(at), ROW_SLICE):
                        part = at[low : low + ROW_SLICE]
                        scans[m.shape[1]].add(keys[part], vec_ids[part], m[low : low + ROW_SLICE])
        for scan in scans.values():
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(scan.results(), schema, strict=True)], schema=schema)

    each = cells.mapInArrow(rows, BOUNDS)
    top = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    least = each.withColumn("n", F.row_number().over(top)).where(F.col("n") == k).select("query_id", F.col("lower").alias("kth"))
    return each.join(least, "query_id", "left").where("kth IS NULL OR upper >= kth").select("query_id", "key", "upper")


def inner_products(queries: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Exact integer scores of one vector with some queries, held within a long."""
    if np.abs(queries).max() * np.abs(row).max() * len(row) < 2**62:
        return queries.astype(np.int64) @ row.astype(np.int64)
    whole = [int(x) for x in row]
    sums = [sum(int(a) * b for a, b in zip(q.tolist(), whole, strict=True)) for q in queries]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


def _scored(exact: DataFrame, pairs: DataFrame, block) -> DataFrame:
    """SCORES of (query_id, key) pairs: each exact vector that a pair names is read once, with its queries (at most a block's)."""
    schema = common.arrow_schema(SCORES)
    wanted = pairs.groupBy("key").agg(F.collect_list("query_id").alias("queries"))

    def rows(batch):
        out = ([], [], [])
        for vec_id, packed, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            row = np.frombuffer(packed, "<f8")
            ids, vectors = block.value[len(row)]
            at = np.searchsorted(ids, asked)
            out[0].append(ids[at])
            out[1].append(np.full(len(at), vec_id))
            out[2].append(inner_products(vectors[at], row))
        yield pa.record_batch([pa.array(np.concatenate([*c, np.empty(0, np.int64)]), pa.int64()) for c in out], schema=schema)

    return common.map_arrow(exact.select("key", "vec_id", "exact").join(wanted, "key").select("vec_id", "exact", "queries"), rows, SCORES)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame):
    """Queries by length, {dim: (ids in order, vectors)}, in blocks of bounded size, read one partition at a time."""
    block: dict[int, list] = {}
    n = size = 0
    ready = lambda: {d: (np.array([i for i, _ in sorted(rows)]), np.stack([v for _, v in sorted(rows, key=lambda r: r[0])])) for d, rows in block.items()}
    for row in queries.toLocalIterator():
        if n >= QUERY_BLOCK or (n and size + len(row.exact) > QUERY_BYTES):
            yield ready()
            block, n, size = {}, 0, 0
        block.setdefault(row.dim, []).append((row.vec_id, np.frombuffer(row.exact, "<f8")))
        n, size = n + 1, size + len(row.exact)
    if block:
        yield ready()


def top_k(df: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest inner products for each row of ``df`` where ``is_query`` (over vec_id) holds."""
    spark = df.sparkSession
    with common.scope(spark):
        exact = common.written(exact_vectors(df, id_col, vector_col, scale).withColumn("key", F.monotonically_increasing_id()), "exact-vectors")
        borders = fitted_borders(exact, bits)
        cells = common.written(approximations(exact, borders), "approximations")
        shared = spark.sparkContext.broadcast(borders)
        path = common.scratch(spark, "top-k", keep=True)
        spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").write.parquet(path)
        queries = exact.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "exact")).alias("q")).select("vec_id", "q.dim", "q.exact")
        for block in _blocks(queries):
            sent = spark.sparkContext.broadcast(block)
            scores = search_block(exact, cells, sent, shared, k)
            ranked(scores, k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            sent.unpersist()
        shared.unpersist()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def search_block(exact: DataFrame, cells: DataFrame, block, borders, k: int) -> DataFrame:
    """SCORES of all exact vectors read for a block's queries; the k best of each query are among them."""
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("upper"), "key")
    candidates = common.written(_scanned(cells, block, borders, k).withColumn("place", F.row_number().over(by_bound)), "candidates")
    first = common.written(_scored(exact, candidates.where(F.col("place") <= 2 * k), block), "first-scores")
    kth = ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = candidates.where(F.col("place") > 2 * k).join(kth, "query_id", "left").where("kth IS NULL OR upper >= kth")
    return first.unionByName(_scored(exact, rest, block))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.v) = len(c.v) THEN list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT END AS score FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores WHERE score IS NOT NULL)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
