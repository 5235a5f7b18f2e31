"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is halved until a leaf has at most LEAF characters; leaves are encoded
on their own and neighbours are joined by encoding a window around their
boundary again. Two rules say how far the window must grow until all tokens
outside of it provably stay:

- *Text level.* A place with a non-space on its left and a space or newline on
  its right always starts a new match of the pattern, whatever stands further
  left or right (no alternative goes from a non-space to white space). Both
  parts can be cut there, so tokens beyond the nearest such places stay.
- *Match level.* One match without such places (a run of letters of any
  length) is itself halved. A token sequence is the BPE encoding of its bytes
  if and only if each two neighbouring tokens are the encoding of their own
  bytes, as merges are taken in order of rank and every token is reached by
  merges. So when the window's new encoding begins with the window's old first
  token and ends with its old last token, everything outside stays; otherwise
  the window doubles on that side, at most to the whole match.

The empty sequence is the identity, and joining is associative, so any tree
gives the tokens of the whole text. Decoding joins the bytes of the halves.
Nothing crosses rows: a document is encoded where it is read.

Defined cases: null is the empty text, which has no tokens; lone surrogates
cannot occur in Spark's UTF-8 strings; strings of special tokens are ordinary
text; very long texts are whole, in one worker; repeated rows are encoded each;
columns named ids, n_tokens, round_trip or decoded are replaced where they are added, others kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import common

LEAF = 512
MATCH_LEAF = 1024
WINDOW = 16
SAFE = re.compile(r"(?<=\S)(?=[ \n])")

TOKENS = [("ids", T.BinaryType()), ("n_tokens", T.LongType())]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class TreeBpe:
    """Encodes and decodes by the tree; ``ranks`` and ``pattern`` as in the rank files."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, match_leaf: int = MATCH_LEAF):
        self.core = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.matches = regex.compile(pattern)
        self.leaf, self.match_leaf = leaf, match_leaf
        self.bytes_of = {rank: token for token, rank in ranks.items()}

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self._flat(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def _flat(self, text: str) -> list[int]:
        """A text's tokens match by match; matches longer than the leaf go through the tree of their own."""
        if len(text) <= self.match_leaf or not self._long_run(text):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for match in self.matches.finditer(text):
            out += self.encode_match(match.group())
        return out

    def _long_run(self, text: str) -> bool:
        """Whether more than ``match_leaf`` characters stand without white space."""
        return max(map(len, text.split()), default=0) > self.match_leaf

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The tokens of left + right, from those of either."""
        if not left or not right:
            return left_ids or right_ids
        size = 64
        while (a := self._last_safe(left, size)) is None:
            size *= 2
        size = 64
        while (b := self._first_safe(right, size)) is None:
            size *= 2
        head, tail = left[a:], right[:b]
        keep = len(left_ids) - len(self._flat(head))
        skip = len(self._flat(tail))
        return left_ids[:keep] + self._flat(head + tail) + right_ids[skip:]

    @staticmethod
    def _last_safe(text: str, size: int) -> int | None:
        low = max(0, len(text) - size)
        places = [m.start() for m in SAFE.finditer(text, low)]
        return places[-1] if places else 0 if low == 0 else None

    @staticmethod
    def _first_safe(text: str, size: int) -> int | None:
        place = SAFE.search(text, 0, min(len(text), size + 1))
        return place.start() if place else len(text) if size >= len(text) else None

    def encode_match(self, match: str) -> list[int]:
        """The tokens of one match of the pattern, which may be very long."""
        return self._bytes(match.encode("utf-8"))

    def _bytes(self, data: bytes) -> list[int]:
        if len(data) <= self.match_leaf:
            return self.core._core_bpe.encode_single_piece(data)
        middle = len(data) // 2
        return self.join_match(self._bytes(data[:middle]), self._bytes(data[middle:]))

    def join_match(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the concatenation of two parts of one match."""
        if not left or not right:
            return left or right
        a = b = WINDOW
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            old = left[len(left) - a :] + right[:b]
            data = self.decode(old)
            new = self.core._core_bpe.encode_single_piece(data)
            left_stays = a == len(left) or new[0] == old[0]
            right_stays = b == len(right) or new[-1] == old[-1]
            if left_stays and right_stays:
                return left[: len(left) - a] + new + right[b:]
            a, b = (a if left_stays else 2 * a), (b if right_stays else 2 * b)

    def decode(self, ids) -> bytes:
        """The bytes of the halves, joined up the tree."""
        if len(ids) <= LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_made: dict[tuple[str, str], TreeBpe] = {}


def tree_bpe(path: str, pattern: str) -> TreeBpe:
    """One encoder for each worker."""
    if (path, pattern) not in _made:
        _made[path, pattern] = TreeBpe(load_ranks(path), pattern)
    return _made[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, checked: bool = False) -> DataFrame:
    """The columns of ``df`` and ``ids`` (little-endian unsigned 32-bit integers) and ``n_tokens``.

    ``checked`` adds ``round_trip``: whether the ids, decoded by the same worker, are the text.
    """
    path, pattern = (path, pattern) if path else default_vocabulary()
    added = [*TOKENS, ("round_trip", T.BooleanType())] if checked else TOKENS
    keep = df.drop(*[n for n, _ in added])
    out = T.StructType([*keep.schema.fields, *(T.StructField(n, t) for n, t in added)])
    schema, at = common.arrow_schema(out), keep.columns.index(text_col)

    def rows(batch) -> Iterator[pa.RecordBatch]:
        bpe, ids, sizes, same = tree_bpe(path, pattern), [], [], []
        for text in common.strings(batch.column(at)):
            own = bpe.encode(text)
            ids.append(np.array(own, "<u4").tobytes())
            sizes.append(len(own))
            if checked:
                same.append(bpe.decode(own) == text.encode())
        new = [pa.array(ids, pa.binary()), pa.array(sizes, pa.int64())] + ([pa.array(same, pa.bool_())] if checked else [])
        yield pa.record_batch([*(c.cast(f.type) for c, f in zip(batch.columns, schema, strict=False)), *new], schema=schema)

    return common.map_arrow(keep, rows, out)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of ``df`` and ``decoded``, the bytes of its ids; null ids give null."""
    path, pattern = (path, pattern) if path else default_vocabulary()
    keep = df.drop("decoded")
    out = T.StructType([*keep.schema.fields, T.StructField("decoded", T.BinaryType())])
    schema, at = common.arrow_schema(out), keep.columns.index(ids_col)

    def rows(batch):
        bpe = tree_bpe(path, pattern)
        texts = [None if x is None else bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(at).to_pylist()]
        yield pa.record_batch([*(c.cast(f.type) for c, f in zip(batch.columns, schema, strict=False)), pa.array(texts, pa.binary())], schema=schema)

    return common.map_arrow(keep, rows, out)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text once and returns (id, n_tokens, ids_sha256, decoded_sha256); the hashes are taken beside the codec."""
    path, pattern = default_vocabulary()
    out = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    schema = common.arrow_schema(out)

    def rows(batch):
        bpe = tree_bpe(path, pattern)
        sizes, ids_hash, text_hash = [], [], []
        for text in common.strings(batch.column(1)):
            ids = bpe.encode(text)
            sizes.append(len(ids))
            ids_hash.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            text_hash.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(x, schema.field(2).type) for x in (ids_hash, text_hash))], schema=schema)

    return common.map_arrow(df.select(F.col(id_col).cast("long").alias(id_col), text_col), rows, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
