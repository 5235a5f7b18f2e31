from collections import Counter

import tiktoken

from tidemark.llm import bpe, common, token_ledger
from tidemark.llm.token_ledger import TokenLedger

SCHEMA = "source string, lang string, tokenizer string, sign int, n_tokens long"


def totals(ledger):
    return {tuple(r)[:3]: tuple(r)[3:] for r in ledger.totals().collect()}


def test_inserts_deletes_revisions_and_repeated_batches(spark):
    ledger = TokenLedger(spark)
    rows = lambda *r: spark.createDataFrame(r, SCHEMA)
    first = rows(("a", "en", "t1", 1, 10), ("a", "en", "t1", 1, 5), (None, None, "t1", 1, 3), ("b", "de", "t1", 1, 0))
    assert ledger.commit(0, first) and not ledger.commit(0, first)
    assert totals(ledger) == {("a", "en", "t1"): (2, 15), (None, None, "t1"): (1, 3), ("b", "de", "t1"): (1, 0)}
    second = rows(("a", "en", "t1", -1, 5), ("b", "de", "t1", -1, 0), (None, None, "t1", -1, 3), (None, None, "t1", 1, 4), ("a", "en", "t2", 1, 8))
    assert ledger.commit(1, second)
    expected = {("a", "en", "t1"): (1, 10), (None, None, "t1"): (1, 4), ("a", "en", "t2"): (1, 8)}
    assert totals(ledger) == expected
    ledger.compact()
    assert not ledger.commit(1, second) and not ledger.commit(0, first)
    assert ledger.commit(3, rows(("c", "fr", "t1", 1, 1)))
    ledger.compact()
    assert ledger._state() == (1, [3]) and totals(ledger) == expected | {("c", "fr", "t1"): (1, 1)}
    ledger.commit(2, rows(("c", "fr", "t1", 1, 2)))
    ledger.compact()
    assert ledger._state() == (3, []) and totals(ledger)["c", "fr", "t1"] == (2, 3)


def test_unfinished_batch_is_not_counted(spark):
    ledger = TokenLedger(spark)
    rows = spark.createDataFrame([("a", "en", "t", 1, 2)], SCHEMA)
    rows.write.parquet(f"{ledger.path}/aside-died")
    assert totals(ledger) == {} and ledger.commit(0, rows)
    assert totals(ledger) == {("a", "en", "t"): (1, 2)}


def test_of_two_writers_one_commits(spark, monkeypatch):
    ledger = TokenLedger(spark)
    rows = spark.createDataFrame([("a", "en", "t", 1, 2)], SCHEMA)
    monkeypatch.setattr(ledger, "holds", lambda batch: False)
    assert [ledger.commit(0, rows) for _ in range(3)] == [True, False, False]
    assert totals(ledger) == {("a", "en", "t"): (1, 2)}
    assert [n for n in common.list_names(spark, ledger.path) if not n.startswith(".")] == ["batch-0"]


def test_totals_outlive_a_compaction(spark):
    ledger = TokenLedger(spark)
    for batch in range(3):
        ledger.commit(batch, spark.createDataFrame([("a", "en", "t", 1, batch)], SCHEMA))
    before = ledger.totals()
    ledger.compact()
    assert [tuple(r) for r in before.collect()] == [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "t", 3, 3)]
    ledger.commit(3, spark.createDataFrame([("b", "en", "t", 1, 1)], SCHEMA))
    ledger.compact()
    names = {n for n in common.list_names(spark, ledger.path) if n.split("-")[0] in ("batch", "snapshot")}
    assert names == {"snapshot-2", "snapshot-3", "batch-3"} and len(totals(ledger)) == 2


def test_clashing_columns_take_no_part(spark):
    ledger = TokenLedger(spark)
    ledger.commit(0, spark.createDataFrame([("a", "en", "t", 1, 2, 9, "x")], SCHEMA + ", n_docs long, text string"))
    assert totals(ledger) == {("a", "en", "t"): (1, 2)}


def test_query_equals_a_recount(spark, tmp_path, docs):
    texts = ["one two", "", None, "línea três", "x" * 5000, "one two"]
    docs(*enumerate(texts)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in token_ledger.query(spark, str(tmp_path)).collect()}
    vocabularies, pattern = token_ledger.versions()
    expected, n = Counter(), Counter()
    for name, path in vocabularies.items():
        library = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
        for row in spark.read.parquet(str(tmp_path / "documents.parquet")).collect():
            expected[row.source, row.lang, name] += len(library.encode_ordinary(row.text or ""))
            n[row.source, row.lang, name] += 1
    assert got == {k: (n[k], expected[k]) for k in n}


def test_empty_ledger_and_empty_batch(spark):
    ledger = TokenLedger(spark)
    assert totals(ledger) == {}
    ledger.commit(0, spark.createDataFrame([], SCHEMA))
    ledger.compact()
    assert totals(ledger) == {} and ledger.holds(0)
