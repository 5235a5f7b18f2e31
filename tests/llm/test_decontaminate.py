import random

import pytest

from tidemark.llm import decontaminate


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, items, threshold=0.8):
    out = []
    for doc_id, text in rows:
        own = grams(text)
        for item_id, item in items:
            s = grams(item)
            if s and len(s & own) >= threshold * len(s) - 1e-9:
                out.append((doc_id, item_id, len(s), len(s & own)))
    return sorted(out, key=str)


@pytest.fixture()
def items(spark):
    return lambda *rows: spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, n_found string")


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice((5, 6, 9, 14, 30, 59, 200))))) for i in range(60)]
    rows = []
    for i in range(80):
        words = say(rng.choice((0, 3, 50, 400, 3000)))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1].split()
            if rng.random() < 0.5:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part
        rows.append((i, " ".join(words)))
    return rows, items


def found(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def test_matches_brute_force(docs, items):
    rows, bench = corpus()
    bench += [(100, ""), (101, None), (102, "only three words"), (103, bench[0][1])]
    rows += [(None, bench[1][1].upper()), (900, "only  three WORDS"), (901, None), (902, ""), (902, bench[2][1]), (902, bench[2][1])]
    assert found(decontaminate.contained(docs(*rows), items(*bench))) == brute(rows, bench)


def test_blocks_of_items_and_keep_clean(docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 7)
    rows, bench = corpus(8)
    assert found(decontaminate.contained(docs(*rows), items(*bench))) == brute(rows, bench)
    kept = decontaminate.keep_clean(docs(*rows), items(*bench))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in rows} - {b[0] for b in brute(rows, bench)})
    assert "ids" in kept.columns


def test_item_deep_inside_a_very_long_document(docs, items):
    rng = random.Random(1)
    words = [f"v{rng.randint(0, 10**6)}" for _ in range(60_000)]
    bench = [(1, " ".join(words[41_000:41_012])), (2, " ".join(words[59_960:])), (3, " ".join(words[:300]))]
    assert found(decontaminate.contained(docs((1, " ".join(words))), items(*bench))) == brute([(1, " ".join(words))], bench)


def test_scattered_items_are_found(docs, items):
    rng = random.Random(12)
    say = lambda n: [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
    bench = [(i, " ".join(say(120))) for i in range(40)]
    rows = []
    for i, text in bench:
        own, filler = text.split(), [say(rng.randint(500, 900)) for _ in range(5)]
        cuts = [own[k : k + 30] for k in range(0, 120, 30)]
        rows.append((i, " ".join(sum((f + c for f, c in zip(filler, cuts, strict=False)), []) + filler[-1])))
    expected = brute(rows, bench)
    assert len(expected) == 40 and found(decontaminate.contained(docs(*rows), items(*bench))) == expected


def test_slices_and_classes(docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE", 64)
    rows, bench = corpus(21)
    assert found(decontaminate.contained(docs(*rows), items(*bench))) == brute(rows, bench)


def test_an_index_is_built_once_a_worker(monkeypatch):
    built = []
    monkeypatch.setattr(decontaminate, "ItemIndex", lambda rows: built.append(len(rows)) or object())
    monkeypatch.setattr(decontaminate, "_built", {})
    first = decontaminate.index_of("a", [(1, "x")])
    assert decontaminate.index_of("a", [(1, "x")]) is first and decontaminate.index_of("b", []) is not first and built == [1, 0]


def test_empty_tables(docs, items):
    assert decontaminate.contained(docs((1, "a")), items((1, "a")).where("item_id < 0")).count() == 0
    assert decontaminate.contained(docs((1, "a")).where("doc_id < 0"), items((1, "a"))).count() == 0
    assert decontaminate.keep_clean(docs((1, "a")), items((1, "a")).where("item_id < 0")).count() == 1
