"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

Each text gets TREES signatures of DEPTH 16-bit min-hashes of its five-word
shingles. A tree holds the texts sorted by signature, so that texts which
share a prefix of d values are neighbours (one sorted prefix trie for each
tree). A pair of similarity s meets at depth d in some tree with probability
p_d(s) = 1-(1-s^d)^TREES, which grows with s. The prefix is shortened from
DEPTH until a pair at the threshold itself, the hardest one asked for, is met
with probability ``recall``; where even one value is too long a prefix (low
thresholds) ValueError is raised. The texts have no say in it: pairs found in a
large group of like texts tell nothing of the pairs missed elsewhere.

Every candidate pair is verified exactly, on the words: a task numbers the
words of its texts and, word by word, the five-word sequences, so no hash can
make two shingles equal. Texts with equal shingle sets (128-bit digest) are one
class and are compared once, by one document's text. A bucket of n texts is
worked in blocks of at most about BLOCK texts and BLOCK_BYTES of text: a task
sees two blocks, verifies the pairs whose first common tree is this bucket's (so
that each pair counts once) and returns a row for each text, not for each pair.
Counting the links between n different near copies takes n^2/2 comparisons by
nature; a text is sent to the tasks of its bucket once for each block.

Defined cases: null text is the empty text; texts without words equal each
other; repeated rows and null ids are documents like others (``keep_first``
keeps any one of rows with equal id and text); very long texts are whole, alone
in a block if need be; other columns take no part; an empty table has no rows.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common, components, shingles
from tidemark.llm.common import id_of

TREES, DEPTH = 32, 8
BLOCK, BLOCK_BYTES = 512, 4 << 20
DENSE = 1 << 22

SKETCH = T.StructType([T.StructField("doc", T.BinaryType()), T.StructField("set", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("size", T.LongType())])
FOUND = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("root", T.BinaryType()), T.StructField("n_links", T.LongType()), T.StructField("n_linked_docs", T.LongType())])


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def chance(s: float | np.ndarray, depth: int) -> float | np.ndarray:
    """Probability that texts of similarity ``s`` share a prefix of ``depth`` in some tree."""
    return 1 - (1 - s**depth) ** TREES


def prefix_depth(threshold: float, recall: float) -> int:
    """The longest prefix that finds pairs at the threshold with probability ``recall``."""
    found = next((d for d in range(DEPTH, 0, -1) if chance(threshold, d) >= recall), 0)
    if not found:
        raise ValueError(f"{TREES} trees cannot find pairs of similarity {threshold} with probability {recall}")
    return found


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, set, sig, bytes of text) of every row."""
    schema = common.arrow_schema(SKETCH)

    def rows(batch):
        family = shingles.MinHash(TREES * DEPTH)
        sets, sigs, sizes = [], [], []
        for text in common.raw(batch.column(1)):
            hashes = shingles.distinct(text.decode("utf-8", "replace"))
            sets.append(set_key(hashes))
            sigs.append(family.short(hashes).tobytes())
            sizes.append(len(text))
        yield pa.record_batch([batch.column(0).cast(pa.binary()), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], schema=schema)

    return common.map_arrow(df.select(common.doc_key(id_col, text_col).alias("doc"), F.col(text_col)), rows, SKETCH)


def trie_members(classes: DataFrame, depth: int) -> DataFrame:
    """(key, tree, set, n, bytes) of the texts that share a prefix of ``depth`` with another text; n and bytes are the bucket's.

    Buckets are counted with partial sums and joined back, so a prefix that
    very many texts share is no single task's.
    """
    width = 2 * DEPTH
    rows = classes.select("set", "size", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    rows = rows.select(F.xxhash64("tree", F.expr(f"substring(sig, tree * {width} + 1, {2 * depth})")).alias("key"), F.col("tree").cast("tinyint").alias("tree"), "set", "size")
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    return rows.drop("size").join(common.written(shared, "buckets"), "key")


def distinct_buckets(members: DataFrame) -> DataFrame:
    """The members of one of each set of equal buckets: trees often hold the same one, and the first tree's stands for all."""
    who = [F.expr("bit_xor(xxhash64(set))").alias("a"), F.expr("bit_xor(xxhash64(1, set))").alias("b")]
    buckets = members.groupBy("key").agg(F.first("n").alias("n"), F.min("tree").alias("tree"), *who)
    kept = buckets.groupBy("n", "a", "b").agg(F.min(F.struct("tree", "key")).alias("k")).select("k.key")
    return members.join(common.written(kept, "distinct-buckets"), "key")


def member_texts(df: DataFrame, classes: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set, node, n_docs, sig, text) of one document of each class in ``members``, met by its whole key."""
    wanted = classes.join(members.select("set").distinct(), "set", "left_semi").select("node", "n_docs", "sig", "set")
    return df.select(common.doc_key(id_col, text_col).alias("node"), F.col(text_col).alias("text")).join(wanted, "node").dropDuplicates(["node"])


def word_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of every text, by text; equal numbers are equal sequences of words."""
    words: dict[str, int] = defaultdict(count(1).__next__)
    owners, columns = [], [[] for _ in range(shingles.WORDS)]
    for i, text in enumerate(texts):
        parts = [np.fromiter(map(words.__getitem__, found), np.int64, len(found)) for found in map(shingles.words, shingles.pieces(text))]
        each = np.concatenate([*parts, np.zeros(max(0, shingles.WORDS - sum(map(len, parts))), np.int64)])
        m = len(each) - shingles.WORDS + 1
        owners.append(np.full(m, i))
        for place, column in enumerate(columns):
            column.append(each[place : place + m])
    number = np.concatenate(columns[0])
    for column in columns[1:]:
        number = np.unique(number * (len(words) + 1) + np.concatenate(column), return_inverse=True)[1].astype(np.int64)
    pairs = np.unique(np.concatenate(owners) * (int(number.max()) + 1) + number)
    return np.divmod(pairs, int(number.max()) + 1)


def overlaps(owner: np.ndarray, shingle: np.ndarray, n: int, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The size of the intersection of each text of ``rows`` with each of ``columns``."""
    held = np.bincount(shingle)
    shared = held[shingle] > 1
    owner, feature = owner[shared], (np.cumsum(held > 1) - 1)[shingle[shared]]
    order = np.argsort(feature, kind="stable")
    owner, feature = owner[order], feature[order]
    out = np.zeros((len(rows), len(columns)), np.float32)
    n_features = int(feature[-1]) + 1 if len(feature) else 0
    step = max(64, min(DENSE // n, n_features))
    for low in range(0, n_features, step):
        a, b = np.searchsorted(feature, [low, low + step])
        dense = np.zeros((n, step), np.float32)
        dense[owner[a:b], feature[a:b] - low] = 1
        out += dense[rows] @ dense[columns].T
    return out


def first_common_tree(sigs: list[bytes], depth: int, rows: np.ndarray | None = None, columns: np.ndarray | None = None) -> np.ndarray:
    """For each pair, the first tree in which both share a prefix of ``depth``; TREES if none."""
    values = np.frombuffer(b"".join(sigs), ">u2").reshape(len(sigs), TREES, DEPTH)[:, :, :depth].astype(np.uint64)
    folded = np.zeros(values.shape[:2], np.uint64)
    for i in range(depth):
        folded = shingles.mix(folded * np.uint64(65537) + values[:, :, i] + np.uint64(1))
    left, right = (folded if x is None else folded[x] for x in (rows, columns))
    first = np.full((len(left), len(right)), TREES, np.int8)
    for t in range(TREES - 1, -1, -1):
        first[left[:, t][:, None] == right[:, t][None, :]] = t
    return first


def least_linked(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of an adjacency matrix, the least number (``left``, ``right``) in its component."""
    far = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(linked, right[None, :], far).min(axis=1))
        new_right = np.minimum(right, np.where(linked, new_left[:, None], far).min(axis=0))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def verify_block(threshold: float, depth: int, tree: int, cross: bool, sides: np.ndarray, nodes: list[bytes], n_docs: np.ndarray, sigs: list[bytes], texts: list[str]) -> list[tuple]:
    """A row (node, root, links, linked documents) for each text with a link that belongs to this block."""
    low = np.flatnonzero(sides == sides.min())
    high = np.flatnonzero(sides != sides.min()) if cross else low
    if not len(high):
        return []
    owner, shingle = word_shingles(texts)
    sizes = np.bincount(owner, minlength=len(texts)).astype(np.float32)
    both = overlaps(owner, shingle, len(texts), low, high)
    ok = both >= (threshold - 1e-9) * (sizes[low][:, None].astype(np.float64) + sizes[high][None, :] - both)
    if not cross:
        ok[np.diag_indices(len(low))] = False
    if ok.any():
        ok &= first_common_tree(sigs, depth, low, high) == tree
    if not ok.any():
        return []
    by_order = sorted(range(len(nodes)), key=nodes.__getitem__)
    order = np.empty(len(nodes), np.int64)
    order[by_order] = np.arange(len(nodes))
    left, right = least_linked(ok, order[low], order[high])
    ends = [(low, left, ok, n_docs[high])] + ([(high, right, ok.T, n_docs[low])] if cross else [])
    out = []
    for members, root, linked, weights in ends:
        links, docs = linked.sum(axis=1), linked @ weights
        out += [(nodes[members[i]], nodes[by_order[root[i]]], int(links[i]), int(docs[i])) for i in np.flatnonzero(links)]
    return out


def verified(members: DataFrame, texts: DataFrame, depth: int, threshold: float) -> DataFrame:
    """FOUND rows of all pairs in the buckets of ``members``."""
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    rows = members.withColumn("blocks", F.least(blocks, F.col("n").cast("int")))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "tree", "set", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    joined = rows.join(texts, "set")
    schema = common.arrow_schema(FOUND)

    def block(key, part):
        _, i, j = (k.as_py() for k in key)
        found = []
        if part.num_rows > 1:
            get = lambda name: part.column(name).to_pylist()
            contents = [x.decode("utf-8", "replace") for x in common.raw(part.column("text").combine_chunks())]
            found = verify_block(threshold, depth, get("tree")[0], i != j, np.array(get("side")), get("node"), np.array(get("n_docs")), get("sig"), contents)
        columns = list(zip(*found, strict=True)) or [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    common.ship(members.sparkSession)
    return joined.groupBy("key", "i", "j").applyInArrow(block, FOUND)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row for each document: doc (its key), node and n_docs (first document and size of its
    class of equal shingle sets), n_links (other classes of similarity ``threshold`` or more),
    n_linked_docs (documents linked, copies included) and root (first document of the connected class)."""
    spark, depth = df.sparkSession, prefix_depth(threshold, recall)
    src = df.select(id_col, text_col)
    with common.scope(spark):
        sketch = common.written(sketches(src, id_col, text_col), "sketches", keep=True)
        first = F.min(F.struct("doc", "size")).alias("first")
        classes = sketch.groupBy("set").agg(first, F.count("*").alias("n_docs"), F.first("sig").alias("sig"))
        classes = common.written(classes.select("set", "first.size", F.col("first.doc").alias("node"), "n_docs", "sig"), "classes")
        members = common.written(trie_members(classes, depth), "trie")
        members = common.written(distinct_buckets(members), "members")
        texts = common.written(member_texts(src, classes, members, id_col, text_col), "texts")
        found = common.written(verified(members, texts, depth, threshold), "links")
        links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.sum("n_linked_docs").alias("n_linked_docs"))
        roots_of = components.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        known = classes.drop("sig", "size").join(links, "node", "left").join(roots_of, "node", "left")
        known = known.select("set", "node", "n_docs", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.coalesce("n_linked_docs", F.lit(0)) + F.col("n_docs") - 1).alias("n_linked_docs"), F.coalesce("root", "node").alias("root"))
        known = common.written(known, "known", keep=True)
    return sketch.select("doc", "set").hint("merge").join(known, "set").drop("set")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of ``df`` without near copies: of each connected class only its first document, once."""
    first = near_duplicates(df, id_col, text_col, threshold).where("doc = root").select(F.col("doc").alias("__tm_doc")).distinct()
    rows = df.withColumn("__tm_doc", common.doc_key(id_col, text_col)).hint("merge").join(first, "__tm_doc", "left_semi")
    return rows.dropDuplicates(["__tm_doc"]).select(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(id_of("doc").alias("doc_id"), id_of("root").alias("class_id"), id_of("node").alias("copy_of"), F.col("n_docs").alias("n_copies"), "n_links", "n_linked_docs")


#: All pairs of classes that share a shingle, and the classes reached from each.
SQL = r"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT DISTINCT r, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM words),
sets AS (SELECT r, count(*) AS size, md5(string_agg(gram, chr(10) ORDER BY gram)) AS key FROM grams GROUP BY r),
classes AS (SELECT key, min(doc_id) AS node, count(*) AS n_copies, min(r) AS r, any_value(size) AS size FROM sets JOIN words USING (r) GROUP BY key),
own AS (SELECT key, size, gram FROM classes JOIN grams USING (r)),
pairs AS (SELECT a.key AS a, b.key AS b FROM own a JOIN own b ON a.gram = b.gram AND a.key <> b.key GROUP BY a.key, b.key, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9),
links AS (SELECT a AS key, count(*) AS n_links, sum(n_copies) AS n_docs FROM pairs JOIN classes ON classes.key = b GROUP BY a),
reach(key, other) AS (SELECT a, b FROM pairs UNION SELECT reach.key, pairs.b FROM reach JOIN pairs ON pairs.a = reach.other),
roots AS (SELECT reach.key, min(node) AS root FROM reach JOIN classes ON classes.key = reach.other GROUP BY reach.key)
SELECT w.doc_id, least(c.node, coalesce(root, c.node)) AS class_id, c.node AS copy_of, c.n_copies, coalesce(n_links, 0) AS n_links, (coalesce(l.n_docs, 0) + c.n_copies - 1)::BIGINT AS n_linked_docs
FROM words w JOIN sets s USING (r) JOIN classes c ON c.key = s.key LEFT JOIN links l ON l.key = s.key LEFT JOIN roots ON roots.key = s.key
"""
