import random

import corpus_pipeline
import tiktoken
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import brute as near
from tidemark.llm import bpe, common

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("tha", "on", "er", "and", "lo", "mi", "re", "st") for b in ("ta", "rin", "del", "s", "ing", "ous", "ly")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(i, say(30)) for i in range(5)]
    rows, labels = [], []
    for i in range(300):
        text = "\n".join(say(40) for _ in range(2)) + "\nThe same footer"
        kind = i % 10
        if kind == 1:
            text = text.replace(" ", " snarkix grumblo ", 2)
        if kind == 2:
            text += "\n" + rng.choice(bench)[1]
        if kind == 3:
            text = rows[-3][1]
        rows.append((i, text, "en", "src0", len(text)))
        labels.append((i, 1, int(kind == 1)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "src0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return bench


def test_each_stage_against_brute_force(spark, tmp_path):
    bench = tables(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        seen.append({r.doc_id: r for r in docs.collect()})
        if seen[1:]:
            assert docs.columns == COLUMNS
        docs = common.written(stage(spark, docs, sf), f"test-{name}")
    first, clean, lines, single, safe = seen
    assert set(first) - set(clean) == {i for i in range(300) if i % 10 == 1}
    assert [i for i, r in lines.items() if "footer" in (r.text or "")] == [0]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in lines.values())
    assert set(lines) <= set(clean)
    roots = {v[0] for v in near([(i, r.text) for i, r in lines.items()]).values()}
    assert set(single) == roots
    assert set(single) - set(safe) == {h[0] for h in leaks([(i, r.text) for i, r in single.items()], bench)}
    last = {r.doc_id: r for r in docs.collect()}
    library = tiktoken.Encoding("l", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()[0]), special_tokens={})
    assert {i: r.n_tokens for i, r in last.items()} == {i: len(library.encode_ordinary(r.text or "")) for i, r in safe.items()}
    assert all(r.round_trip for r in last.values())


def test_clashing_columns_pass_through_the_filters(spark, tmp_path, docs):
    tables(spark, tmp_path)
    df = docs((1, "alpha beta"), (2, "alpha beta"), (None, None)).withColumnRenamed("ids", "n_dropped")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        assert {r.score for r in out.collect()} == {0.5} and {r.n_dropped for r in out.collect()} == {"i"}


def test_run_applies_all_stages(spark, tmp_path):
    tables(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[0] == "doc_id" and out.where("not round_trip").count() == 0
    assert {r.doc_id % 10 for r in out.where("doc_id < 300").collect()}.isdisjoint({1, 2})


def test_run_leaves_only_its_result_in_the_shared_folder(spark, tmp_path):
    tables(spark, tmp_path)
    folder = lambda: set(common.list_names(spark, f"{common.shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"))
    before = folder()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {n.rsplit("-", 1)[0] for n in folder() - before} == {"pipeline-bpe"} and out.count() > 0


def test_empty_tables_pass_through(spark, tmp_path):
    tables(spark, tmp_path)
    none = tmp_path / "none"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(str(none / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(none)).count() == 0
