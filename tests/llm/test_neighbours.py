import math
import random

import numpy as np
import pytest
from graphloom.llm import neighbours
from pyspark.sql import functions as F

from ..conftest import SMALL

SCHEMA = "vec_id long, embedding array<double>, label int, node long, rank string"


def brute(rows, k):
    """(query, rank) -> (vec_id, score) of all neighbours, the vectors that take part given."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a in np.flatnonzero(ids % 50 == 0):
        s = x @ x[a]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[a]]
        out[int(ids[a])] = [(int(ids[j]), float(s[j])) for j in order[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_op11_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got, want = found(neighbours.op11_neighbours(spark, SMALL)), brute(rows, 5)
    assert got.keys() == want.keys() and all(len(g) == 5 for g in got.values())
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.98 * 5 * len(want)
    scores = {q: dict(brute(rows, len(rows))[q]) for q in want}
    assert all(math.isclose(s, scores[q][i], abs_tol=1e-12) for q in got for i, s in got[q])


def test_recall_of_clusters(spark):
    """Narrow clusters that no projection separates, found from entries or from the query's own node."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 24))[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(neighbours.nearest(table, F.col("vec_id") % 50 == 0, degree=20, sample=12, block=128, entries=64)), brute(rows, 5)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)


def test_odd_vectors(spark):
    """Nulls, zeros, infinities, huge and tiny components, other lengths, a third of equal vectors, ties, repeated rows."""
    rnd = random.Random(2)
    good = [(i, [rnd.choice([-2.0, -1.0, 0.5, 1.0, 3.0]) for _ in range(6)]) for i in range(120)]
    same = [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(200, 290)]
    sizes = [(300, [1e300, 2e300, 3e300, 4e300, 5e300, 6e300]), (350, [1e-300, 2e-300, 0.0, 0.0, 5e-300, 6e-300])]
    bad = [(400, None), (450, [0.0] * 6), (500, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (550, [math.nan] * 6), (600, [math.inf, 1.0, 1.0, 1.0, 1.0, 1.0]), (650, []), (700, [1.0, 2.0]), (None, [1.0] * 6)]
    rows = [*good, *same, *sizes]
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in [*rows, *bad, good[50], good[50], same[0]]], SCHEMA)
    got, want = found(neighbours.nearest(table, F.col("vec_id") % 50 == 0)), brute(rows, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)
    assert [i for i, _ in got[200]] == [201, 202, 203, 204, 205] and [i for i, _ in got[250]] == [200, 201, 202, 203, 204]


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_rows(spark, n):
    rows = [(50 * i, [1.0, float(i)]) for i in range(n)]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0))
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in g] for q, g in brute(rows, 5).items() if g} if n else got == {}
