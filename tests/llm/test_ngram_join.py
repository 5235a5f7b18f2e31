import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import components, ngram_join, shingles


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows, threshold=0.8):
    """(doc_id, class, first copy, copies, links) of every row; ids must differ."""
    classes = defaultdict(list)
    for doc_id, text in rows:
        classes[shingle_set(text)].append(doc_id)
    sets = list(classes)
    links = {i: [j for j, t in enumerate(sets) if i != j and len(s & t) >= threshold * len(s | t) - 1e-9] for i, s in enumerate(sets)}
    out = {}
    for i, s in enumerate(sets):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root = min(min(classes[sets[j]]) for j in seen)
        for doc_id in classes[s]:
            out[doc_id] = (root, min(classes[s]), len(classes[s]), len(links[i]), sum(len(classes[sets[j]]) for j in links[i]) + len(classes[s]) - 1)
    return out


def found(df):
    cols = [ngram_join.id_of("doc").alias("d"), ngram_join.id_of("root").alias("r"), ngram_join.id_of("node").alias("c"), "n_docs", "n_links", "n_linked_docs"]
    return {r.d: tuple(r)[1:] for r in ngram_join.near_duplicates(df).select(*cols).collect()}


def near_corpus(seed=1, n=40, copies=6, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, next_id = [], 0
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 2 * words))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((next_id, " ".join(own)))
            next_id += 1
    return rows


def test_matches_brute_force(docs):
    rows = near_corpus() + [(1000, None), (1001, ""), (1002, "  \n"), (1003, "one two"), (1004, "ONE  two"), (-5, "one two three")]
    assert found(docs(*rows)) == brute(rows)


def test_one_large_group_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    rows = near_corpus(seed=4, n=1, copies=1, words=150)
    base = rows[0][1].split()
    rng = random.Random(9)
    for i in range(1, 60):
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
        rows.append((i, " ".join(own)))
    assert found(docs(*rows)) == brute(rows)


def test_keep_first_keeps_one_of_each_class(docs):
    rows = near_corpus(seed=7)
    kept = ngram_join.keep_first(docs(*rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r for r, *_ in brute(rows).values()})
    assert "score" in kept.columns


def test_repeated_rows_null_ids_and_empty_table(docs):
    text = " ".join(f"a{i}" for i in range(30))
    kept = ngram_join.keep_first(docs((None, text), (None, text), (7, text), (7, text), (7, "other words here and there"))).collect()
    assert sorted((r.doc_id, len(r.text)) for r in kept) == [(7, 26), (7, len(text))]
    assert ngram_join.keep_first(docs((1, "a")).where("doc_id < 0")).count() == 0


def test_long_text_in_pieces(monkeypatch):
    text = "  ".join(f"Σw{i % 977}\u00a0x" for i in range(5000))
    whole = shingles.in_order(text)
    monkeypatch.setattr(shingles, "PIECE", 700)
    assert np.array_equal(whole, shingles.in_order(text))
    assert [w for p in shingles.pieces(text) for w in shingles.words(p)] == shingles.words(text)


def test_min_hash_estimates_similarity():
    rng = np.random.default_rng(2)
    family = shingles.MinHash(512)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate((a[:240], rng.integers(0, 2**63, 60, dtype=np.uint64)))
    assert abs((family.minima(a) == family.minima(b)).mean() - 240 / 360) < 0.08


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(12)]
    parent = {v: v for e in edges for v in e}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    expected = {v: top(v) for a, b in edges if a != b for v in (a, b)}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {v for v in parent if v not in expected}
    assert {v: r for v, r in got.items()} == {v: r for v, r in expected.items() if v not in loops}


def test_low_thresholds_lose_no_pairs(docs):
    rng, rows = random.Random(5), []
    for pair in range(60):
        words = [f"p{pair}x{i}" for i in range(110)]
        rows += [(2 * pair, " ".join(words[:84])), (2 * pair + 1, " ".join(words[28:]))]
    rng.shuffle(rows)
    expected = brute(rows, 0.45)
    assert sum(links for *_, links, _ in expected.values()) == 120
    cols = [ngram_join.id_of("doc").alias("d"), ngram_join.id_of("root").alias("r"), ngram_join.id_of("node").alias("c"), "n_docs", "n_links", "n_linked_docs"]
    assert {r.d: tuple(r)[1:] for r in ngram_join.near_duplicates(docs(*rows), threshold=0.45).select(*cols).collect()} == expected
    with pytest.raises(ValueError):
        ngram_join.prefix_depth(0.05, 0.9995)


def test_null_ids_meet_by_their_text_only(docs):
    rows = [(None, f"{'same words in all of these texts here ' * 3} {i}") for i in range(40)] + [(None, "copy of it")] * 30
    out = ngram_join.near_duplicates(docs(*rows)).collect()
    assert len(out) == 70 and sum(r.n_docs == 30 for r in out) == 30


def test_word_shingles_are_numbered_by_words():
    texts = ["a b c d e f", "b c d e f", "", "a b", "ab", "x " * 50, "a b c d e"]
    owner, number = ngram_join.word_shingles(texts)
    mine = [set(number[owner == i].tolist()) for i in range(len(texts))]
    plain = [shingle_set(t) for t in texts]
    assert [[len(a & b) for b in mine] for a in mine] == [[len(a & b) for b in plain] for a in plain]


def pair_missed_at_first_depth():
    """Two texts of similarity 0.8 that meet in a tree at the depth in use, but not at DEPTH."""
    family = shingles.MinHash(ngram_join.TREES * ngram_join.DEPTH)
    depth = ngram_join.prefix_depth(0.8, 0.9995)
    for seed in range(5000):
        words = [f"p{seed}x{i}" for i in range(104)]
        texts = " ".join(words[:94]), " ".join(words[:84] + words[94:])
        sigs = [family.short(shingles.distinct(x)).tobytes() for x in texts]
        trees = [ngram_join.first_common_tree(sigs, d)[0, 1] for d in (ngram_join.DEPTH, depth)]
        if trees[0] == ngram_join.TREES > trees[1]:
            return texts
    raise AssertionError("no such pair")


def test_a_large_group_does_not_hide_a_pair_at_the_threshold(docs):
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"])) for i in range(60)]
    rows += [(100 + i, text) for i, text in enumerate(pair_missed_at_first_depth())]
    expected = brute(rows)
    assert expected[101][0] == 100 and found(docs(*rows)) == expected
    assert found(docs(*rows[-2:])) == brute(rows[-2:])


def test_depth_follows_the_threshold():
    for threshold in (0.8, 0.85, 0.9, 1.0):
        depth = ngram_join.prefix_depth(threshold, 0.9995)
        assert all(ngram_join.chance(s, depth) >= 0.9995 for s in np.linspace(threshold, 1, 20))
