import hashlib
import random
from collections import defaultdict

from tidemark.llm import common, line_dedup
from tidemark.llm.line_dedup import LineRuns


def key(line):
    white = " \t\n\x0b\x0c\r"
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(white))


def brute(rows, min_docs, keep_first=False):
    holders = defaultdict(set)
    for n, (_, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            holders[key(line)].add(n)
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0))
    first = {k: next(n for n in order if n in h) for k, h in holders.items()}
    out = []
    for n, (doc_id, text) in enumerate(rows):
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or len(holders[key(x)]) < min_docs or (keep_first and first[key(x)] == n)]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)


def corpus(seed=3, n=40):
    rng = random.Random(seed)
    pool = ["Shared line", "  shared LINE\t", "É accent", "é accent", "", "   ", "x", "Ünique", "tail\r"]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {rng.random()}" for _ in range(rng.randint(1, 6)))) for i in range(n)]


def test_matches_brute_force(docs):
    rows = corpus()
    assert rows_of(line_dedup.dedup_lines(docs(*rows), min_docs=10)) == brute(rows, 10)


def test_keep_first_and_columns(docs):
    rows = corpus(5)
    out = line_dedup.dedup_lines(docs(*rows), min_docs=5, keep_first=True)
    assert rows_of(out) == brute(rows, 5, True)
    assert {"key", "score", "batch", "lang"} <= set(out.columns)


def test_nulls_empty_and_repeated_rows(docs):
    rows = [(None, "a\nb"), (1, None), (1, None), (2, ""), (3, "a"), (3, "a"), (4, "A \n\nb"), (None, None)]
    assert rows_of(line_dedup.dedup_lines(docs(*rows), min_docs=3)) == brute(rows, 3)


def test_long_text_and_empty_table(docs, spark):
    rows = [(i, "\n".join(f"line {j}" for j in range(20_000 if i == 0 else 5))) for i in range(4)]
    assert rows_of(line_dedup.dedup_lines(docs(*rows), min_docs=4)) == brute(rows, 4)
    assert line_dedup.dedup_lines(docs((1, "a")).where("doc_id < 0")).count() == 0


def test_runs_compact_and_commit_once(docs, spark):
    runs = LineRuns(spark, fanout=2)
    for batch in range(5):
        lines = line_dedup.doc_lines(docs(*[(batch * 10 + i, f"common\nonly {batch}") for i in range(3)]), "doc_id", "text")
        runs.add(batch, lines)
        runs.add(batch, lines)
    assert len(runs._runs()) <= 3
    counts = sorted(r.n_docs for r in runs.totals().collect())
    assert counts == [3] * 5 + [15]


def test_streaming_batches_drop_what_earlier_batches_have(docs, spark):
    runs = LineRuns(spark)
    first = line_dedup.dedup_batch(runs, 0, docs((1, "a\nb"), (2, "a")))
    second = line_dedup.dedup_batch(runs, 1, docs((3, "A\nc"), (4, "c")))
    assert sorted(r.text for r in first.collect()) == ["a", "a\nb"]
    assert sorted(r.text for r in second.collect()) == ["c", "c"]
    assert line_dedup.doc_lines(docs((5, "b\nz")), "doc_id", "text").transform(runs.unseen).count() == 1


def test_streaming_batches_go_by_the_anti_join(docs, spark, monkeypatch):
    runs, calls = LineRuns(spark), []
    unseen = runs.unseen
    monkeypatch.setattr(runs, "unseen", lambda lines: calls.append(1) or unseen(lines))
    line_dedup.dedup_batch(runs, 0, docs((1, "long line\nab\n"), (2, None)), min_chars=3)
    second = line_dedup.dedup_batch(runs, 1, docs((3, "LONG line"), (4, "ab\n\nnew line\nlong line"), (5, None), (6, "ab")), min_chars=3)
    assert len(calls) == 2
    assert {r.doc_id: (r.text, r.n_dropped) for r in second.collect()} == {3: ("", 1), 4: ("ab\n\nnew line", 1), 5: (None, 0), 6: ("ab", 0)}


def one_run(docs, *rows):
    return line_dedup.doc_lines(docs(*rows), "doc_id", "text")


def test_a_late_batch_is_added(docs, spark):
    runs = LineRuns(spark, fanout=2)
    for batch in (0, 1, 2, 4, 3, 3, 9):
        runs.add(batch, one_run(docs, (batch, f"common\nonly {batch}")))
    assert sorted(r.n_docs for r in runs.totals().collect()) == [1] * 6 + [6]
    assert all(runs.holds(b) for b in (0, 1, 2, 3, 4, 9)) and not runs.holds(5)


def test_a_given_store_counts_its_documents(docs, spark):
    runs = LineRuns(spark)
    first = line_dedup.dedup_lines(docs((1, "Same line"), (2, "other")), min_docs=2, batches=2, runs=runs)
    assert sum(r.n_dropped for r in first.collect()) == 0
    again = LineRuns(spark, runs.path)
    second = line_dedup.dedup_lines(docs((3, "same line"), (4, "same LINE\nnew"), (5, "alone")), min_docs=2, batches=2, runs=again)
    assert {r.doc_id: r.n_dropped for r in second.collect()} == {3: 1, 4: 1, 5: 0}
    assert again.buckets == runs.buckets and again.next_batch() == 4


def test_closed_lines_are_left_out_by_the_anti_join(docs, spark):
    runs = LineRuns(spark)
    runs.add(0, one_run(docs, (5, "often"), (6, "often"), (7, "seldom")), min_docs=2)
    runs.add(1, one_run(docs, (8, "often"), (9, "seldom")), min_docs=2)
    assert sorted(r.n_docs for r in runs.totals().collect()) == [2, 2]  # "often" was closed, "seldom" counted
    runs.add(2, one_run(docs, (1, "often"), (10, "often")), min_docs=2, keep_first=True)
    runs.add(3, one_run(docs, (11, "often")), min_docs=2, keep_first=True)
    found = sorted((r.n_docs, r.first_doc[1:9].hex()[-2:]) for r in runs.totals().collect())
    assert found == [(2, "07"), (4, "01")]


def test_the_anti_join_does_not_shuffle_the_runs(docs, spark, monkeypatch):
    runs, plans = LineRuns(spark, buckets=3), []
    write = runs._write
    monkeypatch.setattr(runs, "_write", lambda rows, run: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(rows, run))
    for batch in range(3):
        runs.add(batch, one_run(docs, (batch, f"a\nb{batch}")), min_docs=1)
    assert plans[2].count("SortMergeJoin") == 2 and plans[2].count("Bucketed: true") == 3 and "Exchange" not in plans[2]
    runs.close()
    assert runs.totals().count() == 4 and sorted(r.n_docs for r in runs.totals().collect()) == [1] * 4
    runs.close()


def test_scratch_tables_of_a_failed_run_go(docs, spark, monkeypatch):
    folder = lambda: common.list_names(spark, f"{common.shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}")
    rows = docs((1, "a\nb"), (2, "a"))
    before = set(folder())
    kept = line_dedup.dedup_lines(rows, min_docs=2)
    assert kept.count() == 2 and {n.split("-")[0] for n in set(folder()) - before} == {"lines", "frequent"}
    before = set(folder())
    monkeypatch.setattr(LineRuns, "totals", lambda self: 1 / 0)
    try:
        line_dedup.dedup_lines(rows, min_docs=2)
    except ZeroDivisionError:
        pass
    assert {n.split("-")[0] for n in set(folder()) - before} <= {"lines"}
