"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the number of their distinct five-word shingles: class
k holds 2^k up to 2^(k+1)-1. For class k, a document is cut into overlapping
windows of 2^(k+2) shingles, one each 2^(k+1), so that an item found in one
piece lies whole in some window. An item and the window with a share c of it
have a similarity of c*n / (window + (1-c)*n), at least 0.17 at c = 0.8, and the
share of equal min-hashes is that similarity: with PERMUTATIONS min-hashes they
meet in one at least with a probability of 1 - 1e-5. Of an item in several pieces
each piece adds its share of the same chances (a piece with a share f has f/(5-f)
at least), so scattered items are missed about as seldom; the share that counts
is that of the whole document. Window minima come from block minima, so all size
classes share one pass of hashing; very long documents are taken in slices.

Candidates are verified in place by exact containment: the share of the item's
distinct shingles that the whole document has, on the words themselves.

The items are taken to the workers in blocks of at most BLOCK_ITEMS items and
BLOCK_BYTES of text, one pass over the documents for each block, so the size
of a broadcast does not depend on the size of the benchmark. A worker builds a
block's index once, of about three times the block's text.

Defined cases: null text is empty; an item of under five words is one shingle
of all its words and is found only in a document with exactly these words; an
item without words is never found; repeated items are found each, a repeated
document each time; columns of documents may have any names; empty tables give
no rows (an empty benchmark leaves all documents clean).
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, shingles

PERMUTATIONS = 64
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
CHUNK, SLICE, SIEVE_BITS = 4096, 1 << 16, 20

HITS = [("item_id", T.LongType()), ("n_shingles", T.LongType()), ("n_found", T.LongType()), ("containment", T.DoubleType())]


def size_class(n: int) -> int:
    return n.bit_length() - 1


def word_shingles(text: str | None) -> set[tuple[str, ...]]:
    w = shingles.words(text)
    return {tuple(w[i : i + shingles.WORDS]) for i in range(max(1, len(w) - shingles.WORDS + 1))} if w else set()


class ItemIndex:
    """Min-hashes and shingles of one block of items by size class."""

    def __init__(self, items: list[tuple[int, str]]):
        self.family = shingles.MinHash(PERMUTATIONS)
        self.items = [(i, text) for i, text in items if shingles.words(text)]
        self.hashes = [shingles.distinct(text) for _, text in self.items]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        rows = defaultdict(list)
        for row, h in enumerate(self.hashes):
            rows[size_class(len(h))].append(row)
        for k, members in rows.items():
            keys = np.stack([self._keys(self.family.minima(self.hashes[r])[:, None])[:, 0] for r in members])
            owners = np.repeat(np.array(members), PERMUTATIONS)
            order = np.argsort(keys.ravel(), kind="stable")
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[self._slots(keys)] = True
            self.tables[k] = (keys.ravel()[order], owners[order], sieve)

    @staticmethod
    def _keys(minima: np.ndarray) -> np.ndarray:
        """(permutations, n) minima with the permutation's number above them."""
        return minima.astype(np.uint64) | (np.arange(len(minima), dtype=np.uint64) << np.uint64(32))[:, None]

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SIEVE_BITS)

    def block_minima(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """(permutations, blocks): the minima of consecutive blocks of ``size`` shingles."""
        parts = []
        step = max(size, CHUNK // size * size)
        for low in range(0, len(hashes), step):
            x = (hashes[low : low + step] >> np.uint64(32)).astype(np.uint32)[None, :]
            parts.append(np.minimum.reduceat(self.family.a * x + self.family.b, np.arange(0, x.shape[1], size), axis=1))
        return np.concatenate(parts, axis=1)

    def candidates(self, hashes: np.ndarray) -> set[int]:
        """Rows of the items that share a min-hash with a window of their class."""
        found: set[int] = set()
        if not self.tables:
            return found
        over = 2 ** (max(self.tables) + 1)
        step = -(-SLICE // over) * over
        for low in range(0, len(hashes), step):
            self._slice_candidates(hashes[low : low + step + over], found)
        return found

    def _slice_candidates(self, hashes: np.ndarray, found: set[int]) -> None:
        blocks, size = None, 0
        for k in sorted(self.tables):
            if blocks is None:
                size = 2 ** (k + 1)
                blocks = self.block_minima(hashes, size)
            while size < 2 ** (k + 1):
                size *= 2
                blocks = np.minimum.reduceat(blocks, np.arange(0, blocks.shape[1], 2), axis=1)
            windows = np.minimum(blocks, np.concatenate((blocks[:, 1:], blocks[:, -1:]), axis=1))
            values, owners, sieve = self.tables[k]
            keys = self._keys(windows)
            keys = np.unique(keys[sieve[self._slots(keys)]])
            low, high = np.searchsorted(values, keys), np.searchsorted(values, keys, side="right")
            for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                found.update(owners[a:b].tolist())

    def search(self, text: str, threshold: float) -> list[tuple[int, int, int, float]]:
        """(item, its shingles, those found, containment) of every item that reaches ``threshold`` in a text."""
        hashes = shingles.in_order(text)
        out, own, words = [], None, None
        for row in sorted(self.candidates(hashes)):
            own = np.unique(hashes) if own is None else own
            wanted = self.hashes[row]
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            if (own[at] == wanted).sum() < threshold * len(wanted) - 1e-9:
                continue
            words = word_shingles(text) if words is None else words
            item = word_shingles(self.items[row][1])
            n, hit = len(item), len(item & words)
            if hit >= threshold * n - 1e-9:
                out.append((self.items[row][0], n, hit, hit / n))
        return out


_built: dict[str, ItemIndex] = {}


def index_of(name: str, items: list[tuple[int, str]]) -> ItemIndex:
    """The index of a block, built once for each worker; the one before goes."""
    if name not in _built:
        _built.clear()
        _built[name] = ItemIndex(items)
    return _built[name]


def blocks_of(items: DataFrame, id_col: str, text_col: str):
    """The items in lists of bounded size, read one partition at a time."""
    block, size = [], 0
    for item_id, text in items.select(F.col(id_col).cast("long"), F.col(text_col)).toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(text or "") > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text or "")
    if block:
        yield block


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every item and document with at least ``threshold``."""
    spark = docs.sparkSession
    out = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *(T.StructField(n, t) for n, t in HITS)])
    result = None
    for block in blocks_of(items, item_id, item_text):
        hits = _search(docs.select(doc_id, doc_text), spark.sparkContext.broadcast((uuid.uuid4().hex, block)), out, threshold)
        result = hits if result is None else result.unionByName(hits)
    return spark.createDataFrame([], out) if result is None else result


def _search(docs: DataFrame, block, out: T.StructType, threshold: float) -> DataFrame:
    schema = common.arrow_schema(out)

    def rows(batches):
        index = index_of(*block.value)
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(common.strings(batch.column(1))):
                for hit in index.search(text, threshold):
                    at.append(i)
                    hits.append(hit)
            columns = list(zip(*hits, strict=True)) or [[]] * len(HITS)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())).cast(schema.field(0).type), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)
        common.release()

    common.ship(docs.sparkSession)
    return docs.mapInArrow(rows, out)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns; nothing crosses rows."""
    spark = docs.sparkSession
    for block in blocks_of(items, item_id, item_text):
        docs = _without(docs, spark.sparkContext.broadcast((uuid.uuid4().hex, block)), threshold, text_col)
    return docs


def _without(docs: DataFrame, block, threshold: float, text_col: str) -> DataFrame:
    at, schema = docs.columns.index(text_col), common.arrow_schema(docs.schema)

    def rows(batches):
        index = index_of(*block.value)
        for batch in batches:
            clean = pa.array([not index.search(text, threshold) for text in common.strings(batch.column(at))], pa.bool_())
            kept = batch.filter(clean)
            yield pa.record_batch([c.cast(f.type) for c, f in zip(kept.columns, schema, strict=True)], schema=schema)
        common.release()

    common.ship(docs.sparkSession)
    return docs.mapInArrow(rows, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents
  UNION ALL SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') FROM benchmark),
grams AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM words WHERE len(w) > 0),
sizes AS (SELECT id, count(*) AS n FROM grams WHERE kind = 'i' GROUP BY id),
hits AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found FROM grams d JOIN grams i ON d.gram = i.gram AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / n AS containment FROM hits JOIN sizes ON sizes.id = hits.item_id WHERE n_found >= 0.8 * n - 1e-9
"""
