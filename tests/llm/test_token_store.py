import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import chunk_table, common, token_store
from tidemark.llm.chunk_table import ChunkTable

LIBRARY = Tokenizer.from_file(token_store.default_tokenizer())
SMALL = ChunkTable(token_store.default_tokenizer(), most=40, bits=7)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def brute(rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def stored(df, spark, **options):
    path = common.scratch(spark, "test-tokens")
    token_store.write_tokens(df, path, **options)
    return path


def test_matches_library(docs, spark):
    rng = random.Random(1)
    pieces = ["the", " ", "  ", "\n", "\t", "\x1c", "é", "中文", "'s", "123", "!?", "thing", " <|endoftext|>", "　", " x"]
    rows = [(i * 7 - 100, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(None, "null id"), (5000, None), (5001, "word " * 20_000)]
    path = stored(docs(*rows), spark)
    got = sorted((tuple(r) for r in token_store.checksums(token_store.read_tokens(spark, path)).collect()), key=lambda r: r[1])
    assert got == brute(rows)


def test_repeated_ids_fill_the_range_without_gaps(docs, spark):
    path = stored(docs(*[(3, f"text {i % 4}") for i in range(40)]), spark)
    rows = sorted((tuple(r) for r in token_store.read_tokens(spark, path).select("start", "n_tokens").collect()))
    assert [a + n for a, n in rows[:-1]] == [a for a, _ in rows[1:]] and rows[0][0] == 0


def test_lookup_prunes_and_finds(docs, spark):
    path = stored(docs(*[(i, f"text {i}") for i in range(300)]), spark)
    found = token_store.lookup(spark, path, [7, 250, 9999])
    assert sorted((r.doc_id, r.ids) for r in found.collect()) == [(i, [*ids_of(f"text {i}"), 0]) for i in (7, 250)]


def test_empty_table(docs, spark):
    path = stored(docs((1, "a")).where("doc_id < 0"), spark)
    assert token_store.checksums(token_store.read_tokens(spark, path)).count() == 0


def encoded(table, texts):
    data = [t.encode() for t in texts]
    ids, sizes = table.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
    return ids.tolist(), sizes.tolist()


PIECES = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "\x1c", "\r\n", "'s", "'", "ll", "234", "é", "中", "!", "...", ",", ";", "ß", "😀", "\x85", "\u00a0", "\u2003", "\u3000", "“", "’", "ABC", "ª", "ǅ", "<|endoftext|>", "\u1680", "\u2028", "\u205f", "\n<|endoftext|>", " Wörter.", " x?!", "³", "ʼ", "Mr.X", "\nThe"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), max_size=5))
def test_chunk_table_equals_the_library(texts):
    assert encoded(SMALL, texts) == ([i for t in texts for i in ids_of(t)], [len(ids_of(t)) for t in texts])


def test_collisions_cannot_give_wrong_ids(monkeypatch):
    monkeypatch.setattr(chunk_table, "mix", lambda x: x & np.uint64(3) | np.uint64(1))
    texts = ["one two three", "four five one", " six, seven"] * 3
    table = ChunkTable(token_store.default_tokenizer(), bits=4)
    for _ in range(2):
        assert encoded(table, texts) == ([i for t in texts for i in ids_of(t)], [len(ids_of(t)) for t in texts])


def test_texts_with_more_new_chunks_than_slots():
    table = ChunkTable(token_store.default_tokenizer(), most=40, bits=7)
    text = " ".join(f"w{i}x" for i in range(3000))
    assert encoded(table, [text, "a", text[:50]]) == ([i for t in (text, "a", text[:50]) for i in ids_of(t)], [len(ids_of(t)) for t in (text, "a", text[:50])])
    assert table.count <= 40


def test_one_very_long_text_of_different_numbers():
    table = ChunkTable(token_store.default_tokenizer(), most=10_000, most_bytes=1 << 20)
    text = " ".join(map(str, range(600_000)))
    ids, sizes = encoded(table, [text])
    assert sizes == [len(ids)] and ids == ids_of(text)
    assert table.count <= 10_000 and table._bytes() <= 1 << 20


def test_unbroken_chunks_are_not_held():
    table = ChunkTable(token_store.default_tokenizer())
    text = "x" * 100_000 + " " + "1" * 70 + " end"
    assert encoded(table, [text])[0] == ids_of(text) and int(table.text_ends[table.count]) < 80


def test_special_tokens_are_the_librarys():
    text = "a <|endoftext|> b"
    assert ids_of(text) == encoded(SMALL, [text])[0] == [64, 220, 50256, 275]


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    with open(token_store.default_tokenizer()) as file:
        described = json.load(file)
    described["added_tokens"][0]["lstrip"] = True
    path = str(tmp_path / "other.json")
    with open(path, "w") as file:
        json.dump(described, file)
    table, texts = ChunkTable(path), ["a  <|endoftext|> b", "", "plain words"]
    assert not table.by_chunks and SMALL.by_chunks
    assert encoded(table, texts)[0] == [i for t in table.encode_whole(texts) for i in t] == [i for t in texts for i in Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids]


def test_files_have_run_lengths_row_indexes_and_bloom_filters(docs, spark):
    path = stored(docs(*[(2 * i, "same words") for i in range(12_000)]).coalesce(1), spark)
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    names = [n for n in common.list_names(spark, path) if n.endswith(".orc")]
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"{path}/{names[0]}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getNumberOfRows() > 1000
    rows = reader.rows()
    footer = rows.readStripeFooter(reader.getStripes().get(0))
    assert {str(footer.getColumns(i).getKind()) for i in (1, 2, 3, 5)} == {"DIRECT_V2"}
    assert any("BLOOM_FILTER" in str(footer.getStreams(i).getKind()) and footer.getStreams(i).getColumn() == 1 for i in range(footer.getStreamsCount()))
    found = token_store.lookup(spark, path, [4])
    assert found.count() == 1
    found = token_store.lookup(spark, path, [4])
    assert [r.doc_id for r in found.collect()] == [4] and rows_read(found) <= 1000
    absent = token_store.lookup(spark, path, [4001])
    assert absent.collect() == [] and rows_read(absent) == 0


def rows_read(df):
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
