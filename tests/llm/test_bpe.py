import hashlib
import random

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("library", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = bpe.TreeBpe(RANKS, PATTERN, leaf=5, match_leaf=4)
LARGE = bpe.tree_bpe(PATH, PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'stre01aé中\x1c\x85　")), max_size=80))
def test_tree_equals_library(text):
    ids = SMALL.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert SMALL.decode(ids) == text.encode()


def test_long_matches_and_long_texts():
    rng = random.Random(5)
    for alphabet in ("a", "abcdeth", "é中", " ", "\n ", "!?", "0123"):
        text = "".join(rng.choice(alphabet) for _ in range(20_000))
        assert LARGE.encode(text) == LIBRARY.encode_ordinary(text)
    text = " ".join("".join(rng.choice("aeilnrst") for _ in range(rng.randint(1, 9))) for _ in range(30_000))
    ids = LARGE.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert LARGE.decode(ids) == text.encode()


def test_joining_is_associative():
    a, b, c = "one tw", "o three", " four's 12"
    enc = SMALL.encode
    left = SMALL.join(a + b, SMALL.join(a, enc(a), b, enc(b)), c, enc(c))
    right = SMALL.join(a, enc(a), b + c, SMALL.join(b, enc(b), c, enc(c)))
    assert left == right == LIBRARY.encode_ordinary(a + b + c)
    assert SMALL.join("", [], a, enc(a)) == SMALL.join(a, enc(a), "", []) == enc(a)


def test_encode_decode_frames(docs):
    texts = ["", None, "Hello <|endoftext|> world", "x" * 50_000, "línea\n\n  fin "]
    df = docs(*enumerate(texts)).withColumnRenamed("batch", "decoded")
    out = bpe.decode(bpe.encode(df)).orderBy("doc_id").collect()
    for row, text in zip(out, texts, strict=True):
        assert np.frombuffer(row.ids, "<u4").tolist() == LIBRARY.encode_ordinary(text or "")
        assert bytes(row.decoded) == (text or "").encode() and row.lang == row.lang
    digests = {r.doc_id: r for r in bpe.digests(df).collect()}
    for i, text in enumerate(texts):
        ids = np.array(LIBRARY.encode_ordinary(text or ""), "<u4")
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty_table_and_null_ids(docs):
    assert bpe.digests(docs((1, "a")).where("doc_id < 0")).count() == 0
    assert [r.n_tokens for r in bpe.digests(docs((None, "a b"), (None, "a b"))).collect()] == [2, 2]


def test_checked_encoding_equals_decoding(docs):
    rows = [(1, "some words here " * 200), (2, None), (3, ""), (4, "中文 é \U0001f600 <|endoftext|>")]
    out = bpe.encode(docs(*rows).withColumnRenamed("key", "round_trip"), checked=True)
    assert [r.round_trip for r in out.collect()] == [True] * 4
    assert [bytes(r.decoded).decode() for r in bpe.decode(out).collect()] == [t or "" for _, t in rows]
