import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity

BAD = ["grumblo", "snarkix", "vilefun", "vilefex", "vilefor"]


def corpus(n=400, seed=1, bad=BAD):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("the", "on", "er", "and", "lo", "mi") for b in ("ta", "rin", "del", "s", "ing", "ous")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.25)
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


@pytest.fixture()
def labelled(spark):
    return lambda labels: spark.createDataFrame(labels, "doc_id long, toxic int")


def all_segments(scores, drift):
    """Maximal segments by recursion: the best segment, then the same left and right of it."""
    found = []

    def best(a, b):
        top, at, total = 0.0, None, 0.0
        start = a
        for i in range(a, b):
            if total <= 0:
                total, start = 0.0, i
            total += scores[i]
            if total > top + 1e-12:
                top, at = total, (start, i)
        if at:
            best(a, at[0])
            found.append((*at, round(top, 6)))
            best(at[1] + 1, b)

    best(0, len(scores))
    return found


def test_segments_match_recursion():
    rng = random.Random(2)
    for _ in range(300):
        scores = [-0.5 if rng.random() < 0.6 else round(rng.uniform(-3, 4), 3) for _ in range(rng.randint(0, 40))]
        given = [(i, s) for i, s in enumerate(scores) if s != -0.5]
        assert [(a, b, round(s, 6)) for a, b, s in toxicity.segments(given, 0.5)] == all_segments(scores, 0.5)


def test_segments_stay_linear():
    far = [(i * 100, 1.0) for i in range(200_000)]
    assert len(toxicity.segments(far)) == 200_000


def test_held_out_accuracy_and_unseen_forms(docs, labelled):
    rows, labels = corpus(600)
    model = toxicity.fit(docs(*rows), labelled(labels))
    scored = {r.doc_id: r for r in toxicity.score(docs(*rows), model).collect()}
    held = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((scored[i].score >= toxicity.THRESHOLD) == bool(t) for i, t in held)
    for i, t in held:
        words = rows[i][1].split()
        covered = {j for p in scored[i].passages for j in range(p.first, p.last + 1)}
        assert {j for j, w in enumerate(words) if w in BAD} <= covered if t else not covered
    unseen = toxicity.score(docs((1, "the tale of vilefundo and vilefark on theta"), (2, "thering lous")), model).collect()
    assert unseen[0].score >= 0.7 > unseen[1].score


def test_held_out_labels_are_not_read(docs, labelled):
    rows, labels = corpus(200, seed=3)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    assert toxicity.fit(docs(*rows), labelled(labels)) == toxicity.fit(docs(*rows), labelled(flipped))


def test_nulls_empty_texts_repeats_and_no_labels(docs, labelled):
    rows, labels = corpus(150, seed=4)
    odd = [(None, "grumblo snarkix"), (900, None), (901, ""), (901, ""), (902, "!!! ..."), (903, "grumblo snarkix " * 5000)]
    model = toxicity.fit(docs(*rows, *odd), labelled([*labels, (900, None), (None, 1), (5, 0), (5, 0)]))
    scored = toxicity.score(docs(*odd), model).collect()
    assert [r.score >= 0.7 for r in scored] == [True, False, False, False, False, True]
    assert [r.key for r in scored] == ["k"] * 6
    nothing = toxicity.fit(docs(*rows), labelled(labels).where("doc_id < 0"))
    assert {r.score for r in toxicity.score(docs(*rows), nothing).collect()} == {0.5}
    assert toxicity.score(docs(*rows).where("doc_id < 0"), model).count() == 0
    assert toxicity.fit(docs(*rows).where("doc_id < 0"), labelled(labels)).odds == {}


# ---- the whole operator against a plain version ----


def plain_units(word):
    return [word[:k] + "*" for k in (4, 5, 6) if k < len(word)] + [word]


def plain_odds(train, corpus):
    """Log-odds by the definition, unit by unit with recursion to the parent."""
    n_toxic, n_clean = train[""]

    def parent(unit):
        stem = unit[:-1] if unit.endswith("*") else unit
        return next((stem[:k] + "*" for k in (6, 5, 4) if k < len(stem) and stem[:k] + "*" in train), None)

    def rates(unit):
        if unit is None:
            return 1.0, 1.0
        mean, (toxic, clean) = rates(parent(unit)), train[unit]
        q = max(corpus.get(unit, 0), toxic + clean, 1) / max(corpus[""], 1)
        return (toxic + toxicity.KAPPA * mean[0]) / (n_toxic * q + toxicity.KAPPA), (clean + toxicity.KAPPA * mean[1]) / (n_clean * q + toxicity.KAPPA)

    def odds(unit):
        return math.log(rates(unit)[0] / rates(unit)[1])

    def kept(unit):
        if unit is None:
            return False
        sd = math.sqrt(1 / (train[unit][0] + toxicity.KAPPA) + 1 / (train[unit][1] + toxicity.KAPPA))
        up = parent(unit)
        return abs(odds(unit)) >= toxicity.Z * sd or (kept(up) and abs(odds(up) - odds(unit)) > 0.5)

    return {u: odds(u) for u in train if u and kept(u)}


def test_log_odds_equal_the_plain_version():
    rng = random.Random(8)
    words = ["vilefun", "vilefex", "vile", "grumblo", "grumble", "theta", "thetadel", "lorin", "on"]
    train = {"": (40, 110)}
    for w in words:
        for u in plain_units(w):
            train.setdefault(u, (rng.randint(0, 40) if "vile" in u or "grum" in u else rng.randint(0, 12), rng.randint(5, 60)))
    corpus = {u: sum(c) + rng.randint(0, 500) for u, c in train.items()}
    got, want = toxicity.log_odds(train, corpus), plain_odds(train, corpus)
    assert got.keys() == want.keys() != set() and all(abs(got[u] - want[u]) < 1e-12 for u in want)


def test_lambda_and_k_solve_their_equations():
    rng = random.Random(9)
    scores = Counter(round(rng.uniform(0.1, 5), 1) for _ in range(300))
    n = 20_000
    lam = toxicity.solve_lambda(scores, n)
    top = toxicity.LIMITS[1] - toxicity.DRIFT
    values = [(top, 1), *scores.items(), (-toxicity.DRIFT, n - 300)]
    assert abs(sum(c / (n + 1) * math.exp(lam * s) for s, c in values) - 1) < 1e-6
    steps = [sum(c / (n + 1) * math.exp(x * s) for s, c in values) for x in (lam - 0.01, lam + 0.01)]
    assert steps[0] < 1 < steps[1]


def test_fit_equals_a_plain_fit(docs, labelled, spark):
    rows, labels = corpus(500, seed=11)
    model = toxicity.fit(docs(*rows), labelled(labels))
    known = spark.createDataFrame(labels, "_id long, toxic int").where(~toxicity.held_out("_id"))
    half = {r["_id"]: r.half for r in known.select("_id", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).alias("half")).collect()}
    words = {i: re.findall(r"\w+", t.lower()) for i, t in rows}
    toxic = dict(labels)
    train, everywhere = defaultdict(lambda: [0, 0]), Counter({"": len(rows)})
    for i, own in words.items():
        for w in set(own):
            everywhere.update(plain_units(w))
            if half.get(i) == 0:
                for u in plain_units(w):
                    train[u][1 - toxic[i]] += 1
    train = {u: tuple(c) for u, c in train.items() if sum(c) >= toxicity.MIN_DOCS}
    train[""] = (sum(toxic[i] for i, h in half.items() if h == 0), sum(1 - toxic[i] for i, h in half.items() if h == 0))
    want = plain_odds(train, everywhere)
    assert model.odds.keys() == want.keys() and all(abs(model.odds[u] - want[u]) < 1e-9 for u in want)

    def scan(own):
        chain = [next((want[u] for u in reversed(plain_units(w)) if u in want), None) for w in own]
        scores = [-0.5 if c is None else min(max(c, -3.0), 8.0) - 0.5 for c in chain]
        return all_segments(scores, 0.5), [s for c, s in zip(chain, scores, strict=True) if c is not None and s > 0]

    seen = [(toxic[i], len(words[i]), *scan(words[i])) for i, h in half.items() if h == 1]
    clean = [r for r in seen if not r[0]]
    lam = toxicity.solve_lambda(Counter(round(s, 3) for r in clean for s in r[3]), sum(r[1] for r in clean))
    k = min(1.0, len(clean) / sum(r[1] * math.exp(-lam * max((s for *_, s in r[2]), default=0.0)) for r in clean))
    assert abs(model.lam - lam) < 1e-6 and abs(model.k - k) < 1e-4 * k
    scored = {r.doc_id: r.score for r in toxicity.score(docs(*rows), model).collect()}
    for i, own in words.items():
        e = [max(k * len(own) * math.exp(-lam * s), 1e-300) for *_, s in scan(own)[0]]
        a, b = (min(max(-math.log(min(e)), -10.0), 40.0), math.log1p(sum(x <= 0.01 for x in e))) if e else (-10.0, 0.0)
        z = model.curve[0] + model.curve[1] * a / 10 + model.curve[2] * b
        assert abs(scored[i] - 1 / (1 + math.exp(-min(max(z, -30), 30)))) < 1e-3


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(3)
    x = np.concatenate((np.ones((200, 1)), rng.normal(size=(200, 2))), axis=1)
    y = (x @ [0.2, 1.5, -1.0] + rng.logistic(size=200) > 0).astype(float)
    weight = rng.integers(1, 4, 200).astype(float)
    w = toxicity.logistic(x, y, weight)
    ridge = np.array([1e-6, 1e-2, 1e-2]) * weight.sum() / 100
    assert np.abs(x.T @ (weight * (y - 1 / (1 + np.exp(-x @ w)))) - ridge * w).max() < 1e-5
    assert np.allclose(w, toxicity.logistic(np.repeat(x, weight.astype(int), axis=0), np.repeat(y, weight.astype(int))), atol=1e-6)


def test_one_text_stands_for_a_repeated_label(docs, labelled):
    rows, labels = corpus(200, seed=12)
    many = toxicity.fit(docs(*rows, *[rows[0]] * 50), labelled(labels))
    once = toxicity.fit(docs(*rows, *[(10_000 + i, rows[0][1]) for i in range(50)]), labelled(labels))
    assert many.odds == once.odds and many.curve == once.curve
