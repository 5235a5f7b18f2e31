import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, dim int, score int"


@pytest.fixture()
def vectors(spark):
    return lambda *rows: spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def brute(rows, k=20):
    import numpy as np

    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(df, k=20):
    return sorted(tuple(r) for r in vector_search.top_k(df, F.col("vec_id") % 20 == 0, k).collect())


def test_matches_brute_force_with_ties(vectors):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000 + i, [0.0] * 8) for i in range(30)]
    assert found(vectors(*rows)) == brute(rows)


def test_nulls_and_odd_values_take_no_part(vectors):
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.5, -0.25]), (None, [9.0, 9.0]), (20, [-1.0, 2.0])]
    assert found(vectors(*rows)) == brute(rows)
    assert vector_search.top_k(vectors((1, [1.0])).where("vec_id < 0"), F.lit(True)).count() == 0


def test_query_blocks_and_slices(vectors, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(400)]
    for name, value in (("QUERY_BLOCK", 6), ("QUERY_SLICE", 4), ("ROW_SLICE", 32), ("HELD", 50)):
        monkeypatch.setattr(vector_search, name, value)
    assert found(vectors(*rows), 5) == brute(rows, 5)


def test_repeated_ids(vectors):
    rows = [(20, [1.0, 1.0]), (20, [1.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    assert [(r[0], r[2]) for r in found(vectors(*rows))] == [(20, 7), (20, 7)]


def test_each_length_is_searched_among_its_own(vectors):
    rng = random.Random(5)
    groups = [[(20 * n + i, [rng.uniform(-1, 1) for _ in range(dim)]) for i in range(n_rows)] for n, dim, n_rows in ((0, 3, 50), (10, 8, 70), (30, 1, 21))]
    assert found(vectors(*sum(groups, [])), 5) == sorted(sum((brute(g, 5) for g in groups), []))


def test_any_finite_component(spark):
    import numpy as np

    rows = [(0, [2.0**25, 1.0]), (20, [1e300, -1.0]), (3, [2.0**40, 0.5]), (4, [-1e308, 1e308]), (5, [0.5, 0.5]), (6, [0.25, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with np.errstate(over="ignore"):
        whole = {i: [int(x) for x in np.clip(np.floor(64 * np.array(v)), -vector_search.GREATEST, vector_search.GREATEST)] for i, v in rows}
    expected = []
    for q in (0, 20):
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), -(2**63)), 2**63 - 1), i) for i in whole if i != q)
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert found(df) == expected


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_few_exact_vectors_are_read(vectors, spark, monkeypatch, bits):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centres[i % 30]]) for i in range(1500)]
    read, inner = [], vector_search._scored
    monkeypatch.setattr(vector_search, "_scored", lambda exact, pairs, block: read.append(pairs.count()) or inner(exact, pairs, block))
    got = sorted(tuple(r) for r in vector_search.top_k(vectors(*rows), F.col("vec_id") % 20 == 0, 10, bits=bits).collect())
    assert got == brute(rows, 10)
    assert sum(read) < {2: 0.5, 4: 0.1, 8: 0.03}[bits] * 75 * 1500


def test_approximations_are_small_and_borders_hold_all(vectors):
    rng = random.Random(7)
    df = vectors(*[(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(500)])
    exact = vector_search.exact_vectors(df).withColumn("key", F.monotonically_increasing_id())
    borders = vector_search.fitted_borders(exact)
    rows = vector_search.approximations(exact, borders).collect()
    import numpy as np

    vector = {r.key: np.frombuffer(r.exact, "<f8") for r in exact.collect()}
    for r in rows:
        cells = np.frombuffer(r.cells, np.uint8).astype(int)
        places = np.arange(32)
        assert len(r.cells) == 32 and (borders[32][places, cells] <= vector[r.key]).all() and (vector[r.key] <= borders[32][places, cells + 1]).all()
