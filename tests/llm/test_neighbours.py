"""The forest of random-projection trees against brute force."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from wakeline.llm import neighbours as nn
from wakeline.llm.neighbours import Forest, Layout, best_of, directions, neighbours

SCHEMA = "vec_id long, embedding array<float>"


def found(df):
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return dict(got)


def brute(rows, k=20, every=20):
    """Plain loops: ids with one vector each."""
    out = {}
    for q, x in rows:
        if q % every == 0:
            scored = [(-float(np.dot(x, y)), i) for i, y in rows if i != q and len(x) == len(y)]
            out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got.get(q, [])} & set(ids)) / max(1, len(ids)) for q, ids in want.items()])


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.filter("embedding IS NOT NULL").collect()]
    got, vectors = found(neighbours(df, F.col("vec_id") % 20 == 0)), dict(rows)
    assert all(abs(score - vectors[q] @ vectors[v]) < 1e-12 for q, pairs in got.items() for v, score in pairs)
    assert recall(got, brute(rows)) >= 0.9


def test_clustered_vectors_open_few_leaves(spark, monkeypatch):
    rng, budgets, search = np.random.default_rng(3), [], nn._budget
    monkeypatch.setattr(nn, "_budget", lambda *a: budgets.append(search(*a)) or budgets[-1])
    middles = rng.standard_normal((80, 24))
    x = middles[rng.integers(0, 80, 8000)] + 0.15 * rng.standard_normal((8000, 24))
    rows = list(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = found(neighbours(df, F.col("vec_id") % 20 == 0, leaf_rows=32, shard_rows=1000))
    assert recall(got, brute(rows)) >= 0.9
    assert budgets[0] < 8000 // 5


def test_everything_opened_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.round(4 * v) + [0, 0, 99]) for i, v in enumerate(rng.standard_normal((400, 3)))]  # whole numbers: exact, many ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = found(neighbours(df, F.col("vec_id") % 20 == 0, k=7, leaf_rows=16, shard_rows=64, recall=1.0, probes=1000))
    assert {q: [v for v, _ in p] for q, p in got.items()} == brute(rows, 7)


def test_odd(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (8, [-1.0, 0.0])]
    got = found(neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=3))
    assert got == {0: [(1, 1.0), (2, 1.0), (20, 0.5)], 20: [(0, 0.5), (1, 0.5), (2, 0.5)]}
    assert neighbours(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_lengths_are_searched_apart(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (20, [1.0, 0.0, 0.0]), (21, [0.0, 2.0, 0.0]), (22, [3.0, 0.0, 0.0]), (40, [1.0])]
    got = found(neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 0.5)], 20: [(22, 3.0), (21, 0.0)]}


def test_an_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.0]), (2, [0.0, 0.8]), (3, [-1.0, -1.0])]
    got = found(neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=2))
    assert got == {0: [(1, 0.9), (2, 0.8)]}


def test_a_large_class_of_copies_that_asks(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000, [2.0, 1.0])]
    got = found(neighbours(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=4))
    assert len(got) == 16
    for q in range(0, 300, 20):
        assert got[q] == [(v, 5.0) for v in [i for i in range(6) if i != q][:4]]
    assert got[1000] == [(v, 4.0) for v in range(4)]


def test_clashing_and_further_columns(spark):
    names = ["print", "x", "is_query", "leaf", "shard", "tree", "query_id", "score", "n"]
    rows = [(i, [float(i), 1.0], *["z"] * len(names)) for i in (0, 1, 2, 20)]
    df = spark.createDataFrame(rows, SCHEMA + "".join(f", {n} string" for n in names))
    assert [v for v, _ in found(neighbours(df, F.col("vec_id") % 20 == 0))[20]] == [2, 1, 0]


def test_forest_parts():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 6))
    forest = Forest(directions(x, float(np.linalg.norm(x, axis=1).max())), 2, 4)
    leaves = forest.leaf(directions(x, float(np.linalg.norm(x, axis=1).max())))
    counts = np.array([np.bincount(t, minlength=16) for t in leaves])
    assert counts.min() > 500 // 16 // 3
    # A walk opens leaves in the order that `reached` counts.
    q = np.append(x[0] / np.linalg.norm(x[0]), 0.0)
    order = forest.walk(q, [memoryview(c) for c in counts], 10**9, 1)
    assert sorted(order) == [(t, n) for t in range(2) for n in range(16)]
    before = np.concatenate(([0], np.cumsum([counts[t, n] for t, n in order])))
    first = [min(before[order.index((t, leaves[t, i]))] for t in range(2)) for i in range(500)]
    assert forest.reached(q, counts, leaves).tolist() == first
    assert Layout(counts, 100).blocks.shape[0] == 2
    r, c = best_of(np.array([[1.0, 3.0, 3.0, -np.inf], [2.0, 2.0, 2.0, 2.0]]), np.array([7, 9, 8, 1]), 2)
    assert list(zip(r.tolist(), c.tolist(), strict=True)) == [(0, 2), (0, 1), (1, 3), (1, 0)]


def test_far_more_rows_than_the_sample(spark, monkeypatch):
    """A sample 400 times smaller than the table: full lists, leaves of a like size, and the recall all the same."""
    rng, forests, file = np.random.default_rng(11), [], nn._file
    monkeypatch.setattr(nn, "_file", lambda forest, *a: forests.append(forest) or file(forest, *a))
    middles = rng.standard_normal((60, 16))
    x = middles[rng.integers(0, 60, 16_000)] + 0.2 * rng.standard_normal((16_000, 16))
    rows = list(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = found(neighbours(df, F.col("vec_id") % 200 == 0, leaf_rows=64, sample_rows=40, shard_rows=2000))
    assert len(got) == 80 and all(len(p) == 20 for p in got.values())
    assert recall(got, brute(rows, every=200)) >= 0.9
    forest = forests[0]
    assert forest.known == forest.depth == 8
    sizes = [np.bincount(t, minlength=256).max() for t in forest.leaf(directions(x, float(np.linalg.norm(x, axis=1).max())))]
    assert max(sizes) < 4 * 64


def test_lists_are_full_at_a_budget_of_one(spark, monkeypatch):
    monkeypatch.setattr(nn, "_budget", lambda *a: 1)
    rng = np.random.default_rng(2)
    rows = list(enumerate(rng.standard_normal((3000, 8))))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = found(neighbours(df, F.col("vec_id") % 100 == 0, leaf_rows=8))
    assert len(got) == 30 and all(len(p) == 20 for p in got.values())
