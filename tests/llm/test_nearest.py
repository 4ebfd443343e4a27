import math

import numpy as np
import pytest

import __spark_entry__ as entry_module
from dealweave.llm import nearest
from tests.compare import DATA

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, t int, b int, rank int, score double"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 5, "x", 0, 0, 0, 0.5) for i, v in vectors], SCHEMA)


def brute_force(vectors, k, every=20):
    """(query, rank, id, score) over the valid vectors of the given rows; scores summed as numpy sums one row."""
    part = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in part]
    part = [(i, v) for i, v in part if len(v) == max(set(sizes), key=lambda n: (sizes.count(n), n))]
    out = []
    for q in sorted({i for i, _ in part if i % every == 0}):
        best = {}
        for own in (v for i, v in part if i == q):
            for i, v in part:
                if i != q:
                    best[i] = max(best.get(i, -math.inf), float((own * v).sum()))
        out += [(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def recall(got, want):
    a, b = {(g[0], g[2]) for g in got}, {(w[0], w[2]) for w in want}
    return len(a & b) / len(b)


def vectors(n, dim, seed, clusters=12, spread=0.3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dim))
    return [(i, centers[rng.integers(clusters)] * rng.uniform(0.2, 3) + spread * rng.normal(size=dim)) for i in range(n)]


QUERY = "id % 20 = 0"


@pytest.mark.parametrize("n,dim,bucket,spread", [(3000, 16, 100, 0.3), (3000, 8, 300, 2.0), (2500, 32, 200, 1.0)])
def test_recall_against_brute_force(spark, n, dim, bucket, spread):
    rows = vectors(n, dim, n + dim, spread=spread)
    got = found(nearest.nearest(table(spark, rows), QUERY, k=10, bucket=bucket))
    want = brute_force(rows, 10)
    assert recall(got, want) >= 0.9 and len(got) == len(want)
    exact = {(q, i): s for q, _, i, s in brute_force(rows, n)}
    assert all(abs(exact[q, i] - s) <= 1e-12 * max(1, abs(s)) for q, _, i, s in got)
    for a, b in zip(got, got[1:]):
        assert a[0] != b[0] or (b[1] == a[1] + 1 and (a[3] > b[3] or (a[3] == b[3] and a[2] < b[2])))


def test_visits_are_a_part_of_the_buckets(spark):
    """Neighbours of clustered data are found in a small part of the rows."""
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(200, 16))[rng.integers(200, size=20_000)] + 0.05 * rng.normal(size=(20_000, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    largest = float(np.linalg.norm(rows, axis=1).max())
    index = nearest.Index(rows[:2048], largest, len(rows), 20, 2, 100)
    codes = index.buckets(rows)
    seen = [np.isin(codes[:, t], visits).mean() for q in index.visits(rows[:50], 0.8) for t, (visits, _) in enumerate(q)]
    assert np.mean(seen) < 0.35


def test_visits_come_in_falling_chance_without_repeats():
    rows = np.random.default_rng(2).normal(size=(500, 6))
    index = nearest.Index(rows, float(np.linalg.norm(rows, axis=1).max()), 10_000, 5, 2, 50)
    for tables in index.visits(rows[:20], 0.9):
        for visits, first in tables:
            assert len(set(visits.tolist())) == len(visits) >= first > 0
    own = index.buckets(rows / np.linalg.norm(rows, axis=1)[:, None] * index.largest)  # stored like queries: of full length
    first = [[t[0][0] for t in q] for q in index.visits(rows, 0.01)]
    assert np.mean(np.array(first) == own) > 0.9


@pytest.mark.parametrize("block", [1 << 18, 1])
def test_hot_bucket_ties_and_exact_rest(spark, monkeypatch, block):
    """A third of all rows has one vector: blocks stay bounded, ties go to the smaller id."""
    monkeypatch.setattr(nearest, "BLOCK", block)
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else rng.normal(size=4)) for i in range(900)]
    got = found(nearest.nearest(table(spark, rows), QUERY, k=5, bucket=100))
    want = brute_force(rows, 5)
    hot = [(q, r, i) for q, r, i, _ in want if q % 60 == 0]
    assert [(q, r, i) for q, r, i, _ in got if q % 60 == 0] == hot
    assert recall(got, want) >= 0.9 and len(got) == len(want)


def test_awkward_rows(spark):
    rows = [(0, [1, 0]), (20, [0, -2]), (20, [3, 3]), (1, [1, 1]), (1, [1, 1]), (2, None), (3, []), (4, [0, 0]), (5, [None, 1]), (6, [float("nan"), 1]), (7, [float("inf"), 1]),
            (None, [9, 9]), (8, [1, 2, 3]), (9, [1e30, 1]), (-40, [0, 5]), (10, [0, 5])]
    got = found(nearest.nearest(table(spark, rows), QUERY, k=20))
    assert got == sorted(brute_force(rows, 20))
    assert nearest.nearest(table(spark, []), QUERY).count() == 0
    assert nearest.nearest(table(spark, [(0, [1.0])]), QUERY).count() == 0
    assert nearest.nearest(table(spark, [(1, [1.0]), (2, [2.0])]), QUERY).count() == 0


def test_query_reaches_the_recall(spark):
    sf = f"{DATA}/sf0.01"
    got = found(entry_module.queries()["op13_nearest"](spark, sf))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_force(rows, 20)
    assert recall(got, want) >= 0.9 and [g[:2] for g in got] == [w[:2] for w in sorted(want)]
