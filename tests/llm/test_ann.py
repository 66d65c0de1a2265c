import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from akuru.llm import ann, queries


def brute(rows, is_query, k=20):
    """All inner products in double precision, ties to the smaller id."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32)
    out = {}
    for i, v in zip(ids, x, strict=True):
        if is_query(i):
            s = (x.astype(np.float64) * v.astype(np.float64)).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def recall(got, want):
    hit = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hit / sum(len(w) for w in want.values())


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_whole_query_recall(spark, size):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").collect()]
    want = brute(rows, lambda i: i % 20 == 0)
    got = collect(queries.op9_nearest_neighbours(spark, f"/root/testdata/{size}"))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.97
    exact = {(q, v): s for q, w in want.items() for v, s in w}
    assert all(s == exact[q, v] for q, w in got.items() for v, s in w if (q, v) in exact)


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32))
    x[500:2500] = x[500] + 0.01 * rng.normal(size=(2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(collect(ann.search(df, F.col("vec_id") % 50 == 0)), brute(rows, lambda i: i % 50 == 0)) >= 0.95


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(0).normal(size=(600, 16)).astype(np.float32)
    books = ann.train(x, 4, 32)
    greedy = (ann.encode(x, books, 1)[1] ** 2).sum()
    codes, left = ann.encode(x, books, 8)
    assert (left**2).sum() < greedy
    assert np.allclose(x - sum(b[codes[:, m]] for m, b in enumerate(books)), left, atol=1e-4)


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (60, [1.0, math.nan]), (80, [math.inf, 1.0]), (100, [1.0, None]), (140, []), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [2.0, 0.0]), (160, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = collect(ann.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(3, 2.0), (1, 0.5), (2, 0.5), (160, -1.0)], 160: [(1, -0.5), (2, -0.5), (0, -1.0), (3, -2.0)]}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df, F.col("vec_id") < 0).count() == 0


def test_other_lengths_and_repeated_ids_take_part(spark):
    """A shorter vector ends in zeros; every row but the query's own is a candidate, also one with its id."""
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, [1.0, 1.0, 5.0]), (2, [1.0, 1.0, 5.0]), (0, [0.0, 1.0])]
    got = sorted(map(tuple, ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()))
    first = [(2, 3.0), (2, 3.0), (1, 3.0), (0, 2.0)]  # of [1, 2]
    second = [(0, 2.0), (2, 1.0), (2, 1.0), (1, 0.0)]  # of [0, 1]
    rank = lambda found: [(0, k + 1, v, s) for k, (v, s) in enumerate(sorted(found, key=lambda x: (-x[1], x[0])))]
    assert got == sorted(rank(first) + rank(second))


def test_doubles_are_scored_as_doubles(spark):
    x = 1 + 2.0**-40
    got = ann.search(spark.createDataFrame([(0, [x, 0.0]), (1, [x, 1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).first()
    assert got.score == x * x


@pytest.mark.parametrize("naming", [1, 2])
def test_cells_and_split_blocks(spark, monkeypatch, naming):
    """Small blocks, so that cells are split and queries of a block are divided; a third of all vectors in one place."""
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.2 * rng.normal(size=(1500, 16))
    x[1000:] = x[1000] + 0.02 * rng.normal(size=(500, 16))
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collect(ann.search(df, F.col("vec_id") % 10 == 0, words=16, two_words=1 if naming == 2 else 10**9))
    want = brute(rows, lambda i: i % 10 == 0)
    assert recall(got, want) >= 0.97 and all(len(got[q]) == 20 for q in want)


def test_most_cells_are_passed_over():
    """Of clustered vectors a query visits few cells, however many there are."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(64, 32)), 40, axis=0) + 0.1 * rng.normal(size=(2560, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    books = ann.train(x, 4, 64)
    codes, _ = ann.encode(x, books)
    coarse = np.linalg.norm(x - books[0][codes[:, 0]], axis=1)
    names = np.unique(codes[:, 0])
    cells = ann.Cells(books, names[:, None], np.array([coarse[codes[:, 0] == c].max() for c in names]), np.arange(len(names)), np.ones(len(names), int))
    bars = np.sort(x @ x[::50].T, axis=0)[-21]
    visited = cells.route(x[::50], bars)
    assert np.mean([len(v) for v in visited]) < 0.2 * len(names)
