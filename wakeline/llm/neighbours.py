"""Approximate nearest neighbours with a forest of random-projection trees (operator 8).

* Equal vectors (equal 128-bit hashes) are one class, filed once under its smallest id; a large group of copies costs one row.
* A tree has one random direction a level, orthogonal to those of its other levels, and at every node the median of a bounded sample as
  threshold: of `sample_rows` classes with the smallest hash for the upper levels, as far as they leave 32 to a node, and of samples of the nodes' own
  classes below. Depth grows with the logarithm of the number of classes, so a leaf holds about `leaf_rows` of them at any size (up to `most_depth`). Inner products become directions by the usual extra coordinate sqrt(max^2 - |x|^2).
* A query walks all trees through one shared priority queue, in the order of the summed distances to the hyperplanes on whose far side a
  node lies, until the leaves that it has opened hold `budget` classes, and k + 1 different ones.
* The budget is not a share of the table: it is what `probes` sample queries, searched by brute force over all classes, need to find
  `recall` of their neighbours. On vectors with structure that is a small number of leaves; on vectors without any it is a large part of all.
* Leaves of neighbouring subtrees lie in one shard of about `shard_rows` classes. A query meets a shard once, with the list of the leaves
  that it opens there; only those are scored, by the exact inner product in double precision.

Defined results: null vectors, zero vectors, vectors with null or non-finite components and rows without an id take no part; vectors of
different length have no inner product, so each length is searched on its own; with fewer candidates than k all are returned; a repeated id with
one vector counts once, with several vectors it is named once, with its best score, and asks with all of them; an empty table gives no
rows; further columns are ignored, whatever their names; equal scores go to the smaller id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, parts

RESULT = "query_id long, rank int, vec_id long, score double"


#: Sampled rows that a node needs for its threshold.
NODE_ROWS = 32


def medians(at: np.ndarray, node: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sets the threshold of every node that has rows to their median; those without keep 0, where rows of a normal projection divide. Returns the
    rows' nodes one level below."""
    order = np.argsort(node, kind="stable")
    nodes, starts = np.unique(node[order], return_index=True)
    for n, rows in zip(nodes, np.split(order, starts[1:]), strict=True):
        cuts[n] = np.median(at[rows])
    return 2 * node + (at > cuts[node])


class Forest:
    """Trees as arrays. Level l of a tree has one direction and 2**l thresholds, which stand at 2**l - 1 and after.

    A sample gives thresholds to as many levels as leave NODE_ROWS of it to a node; `known` says how many that are. Deeper levels get theirs from
    further samples, one for each node at that depth (see _grow)."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng, dim = np.random.default_rng(seed), sample.shape[1]
        self.depth = depth
        self.known = min(depth, max(0, int(len(sample) // NODE_ROWS).bit_length()))
        self.planes, self.cuts = np.zeros((trees, dim, depth)), np.zeros((trees, (1 << depth) - 1))
        for t in range(trees):
            random = rng.standard_normal((dim, depth))
            self.planes[t] = np.linalg.qr(random)[0] if 0 < depth <= dim else random / np.linalg.norm(random, axis=0)
            at, node = sample @ self.planes[t], np.zeros(len(sample), np.int64)
            for level in range(self.known):
                node = medians(at[:, level], node, self.cuts[t, (1 << level) - 1 : (2 << level) - 1])

    def node(self, x: np.ndarray, t: int, depth: int) -> np.ndarray:
        """Rows of directions -> their nodes in tree t at a depth."""
        at, node = x @ self.planes[t][:, :depth], np.zeros(len(x), np.int64)
        for level in range(depth):
            node = 2 * node + (at[:, level] > self.cuts[t, (1 << level) - 1 + node])
        return node

    def set_cuts(self, t: int, top: int, below: np.ndarray) -> None:
        """Thresholds of the subtree under node `top` of the known depth, as a small tree of its own."""
        for level in range(int(len(below) + 1).bit_length() - 1):
            start = (1 << (self.known + level)) - 1 + (top << level)
            self.cuts[t, start : start + (1 << level)] = below[(1 << level) - 1 : (2 << level) - 1]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Rows of directions -> trees by rows, the leaf of each."""
        out = np.zeros((len(self.planes), len(x)), np.int64)
        for node, planes, cuts in zip(out, self.planes, self.cuts, strict=True):
            at = x @ planes
            for level in range(self.depth):
                node[:] = 2 * node + (at[:, level] > cuts[(1 << level) - 1 + node])
        return out

    def walk(self, x: np.ndarray, filed: list[memoryview], budget: int, least: int) -> list[tuple[int, int]]:
        """Leaves of all trees in the order of one queue, until those opened hold budget rows, and those of some tree `least` (which differ, as
        the leaves of a tree do). filed: rows by tree and leaf."""
        at = np.einsum("tdl,d->tl", self.planes, x).tolist()
        cuts = [memoryview(c) for c in self.cuts]
        queue = [(0.0, t, 0, 0) for t in range(len(cuts))]
        found, held = [], [0] * len(cuts)
        while queue and (sum(held) < budget or max(held) < least):
            far, t, level, node = heapq.heappop(queue)
            for m in at[t][level:]:
                m -= cuts[t][(1 << level) - 1 + node]
                right, level = int(m > 0), level + 1
                heapq.heappush(queue, (far + abs(m), t, level, 2 * node + 1 - right))
                node = 2 * node + right
            if filed[t][node]:
                found.append((t, node))
                held[t] += filed[t][node]
        return found

    def reached(self, x: np.ndarray, filed: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """How many rows a walk from x opens before it comes to each of some rows, given by their leaves (trees by rows)."""
        at, far = np.einsum("tdl,d->tl", self.planes, x), np.zeros((len(self.planes), 1))
        for level in range(self.depth):
            m = at[:, level : level + 1] - self.cuts[:, (1 << level) - 1 : (2 << level) - 1]
            far = np.stack((far + np.maximum(m, 0), far + np.maximum(-m, 0)), axis=2).reshape(len(far), -1)
        order = np.argsort(far, axis=None, kind="stable")
        before = np.empty(far.size, np.int64)
        before[order] = np.cumsum(filed.reshape(-1)[order]) - filed.reshape(-1)[order]
        return before.reshape(far.shape)[np.arange(len(far))[:, None], leaves].min(0)


def directions(x: np.ndarray, most: float) -> np.ndarray:
    """Candidates as unit vectors: scaled by the longest, and the rest as one more coordinate."""
    x = x / most
    return np.column_stack((x, np.sqrt(np.clip(1 - (x * x).sum(1), 0, None))))


def asked_way(x: np.ndarray) -> np.ndarray:
    """Queries as unit vectors with no part in the further coordinate."""
    return np.column_stack((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))))


def matrix(vectors: pa.Array, kind: str) -> np.ndarray:
    """A column of vectors of one length, as lists or as bytes, in double precision."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if pa.types.is_binary(vectors.type):
        return np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(len(vectors), -1).astype(float)
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(float)


def as_bytes(x: np.ndarray, kind: str) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(x, kind)], pa.binary())


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best scores of each row, ties to smaller ids; places of -inf are none."""
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        r, c = np.nonzero((scores >= least) & (scores > -np.inf))
    else:
        r, c = np.nonzero(scores > -np.inf)
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], c[keep]


class Layout:
    """Where leaves lie: a shard is a subtree of about shard_rows rows, cut into blocks where it is larger than it should be."""

    def __init__(self, counts: np.ndarray, shard_rows: int):
        depth = int(counts.shape[1]).bit_length() - 1
        top = min(depth, max(0, math.ceil(math.log2(max(1, counts[0].sum() / shard_rows)))))
        self.shift = depth - top
        self.blocks = np.maximum(1, -(-counts.reshape(len(counts), 1 << top, -1).sum(2) // (2 * shard_rows)))


def _grow(reps: DataFrame, n: int, forest: Forest, most: float, kind: str, sample_rows: int) -> None:
    """Thresholds of the next levels: every node at the known depth takes a sample of its own rows and divides it. A node's sample has about
    sample_rows rows at most (never fewer than four levels need), so tasks stay small however large the table is."""
    levels = min(forest.depth - forest.known, max(4, int(sample_rows // NODE_ROWS).bit_length() - 1))
    share = min(1.0, NODE_ROWS * 2.0 ** (forest.known + levels) / n)
    known, names = forest.known, ["tree", "node", "x"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = directions(matrix(batch.column(0), kind), most) if batch.num_rows else None
            for t in range(len(forest.planes) if batch.num_rows else 0):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(forest.node(x, t, known)), as_bytes(x, "<f8")], names=names)

    def divide(key: tuple, rows: pa.Table) -> pa.Table:
        t = key[0].as_py()
        at, node = matrix(rows["x"], "<f8") @ forest.planes[t][:, known : known + levels], np.zeros(rows.num_rows, np.int64)
        below = np.zeros((1 << levels) - 1)
        for level in range(levels):
            node = medians(at[:, level], node, below[(1 << level) - 1 : (2 << level) - 1])
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([key[1].as_py()], pa.int64()), "cuts": pa.array([below.tolist()], pa.list_(pa.float64()))})

    some = reps.filter(F.pmod(F.xxhash64(F.lit(known), "print"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))).select("x")
    cuts = some.mapInArrow(dealt, "tree int, node long, x binary").groupBy("tree", "node").applyInArrow(divide, "tree int, node long, cuts array<double>")
    for r in cuts.toLocalIterator():  # thresholds, which the driver holds anyhow
        forest.set_cuts(r["tree"], r["node"], np.array(r["cuts"]))
    forest.known += levels


def _file(forest: Forest, layout: Layout, most: float, kind: str):
    """Every class in its leaf of every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch.column(2), kind), batch.column(0).to_numpy()
            data = as_bytes(x, kind)
            for t, leaf in enumerate(forest.leaf(directions(x, most))):
                shard = leaf >> layout.shift
                block = (ids * 0x9E3779B1 >> 16) % layout.blocks[t, shard]
                cols = [pa.array(np.full(len(ids), t, np.int32)), pa.array(shard), pa.array(block), batch.column(0), batch.column(1), pa.array(leaf), data]
                yield pa.RecordBatch.from_arrays(cols, names=["tree", "shard", "block", "vec_id", "print", "leaf", "x"])

    return run


def _count(forest: Forest, most: float, kind: str):
    """Rows of a partition by tree and leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(forest.planes), 1 << forest.depth), np.int64)
        for batch in batches:
            if batch.num_rows:
                for t, leaf in enumerate(forest.leaf(directions(matrix(batch.column(0), kind), most))):
                    total[t] += np.bincount(leaf, minlength=total.shape[1])
        tree, leaf = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(leaf), pa.array(total[tree, leaf])], names=["tree", "leaf", "n"])

    return run


def _ask(forest: Forest, layout: Layout, counts: np.ndarray, budget: int, least: int, kind: str):
    """Each query once for every shard in which it opens leaves, with those leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = [memoryview(c) for c in counts]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = matrix(part.column(2), kind)
                rows: list[tuple] = []
                for i, q in enumerate(asked_way(x)):
                    opened = np.array(forest.walk(q, filed, budget, least), np.int64).reshape(-1, 2)
                    place = (opened[:, 0] << 40) | (opened[:, 1] >> layout.shift)
                    for p in np.unique(place):
                        t, shard = int(p >> 40), int(p & ((1 << 40) - 1))
                        leaves = opened[place == p, 1].tobytes()
                        rows += [(i, t, shard, b, leaves) for b in range(int(layout.blocks[t, shard]))]
                took, tree, shard, block, leaves = zip(*rows, strict=True)
                took = pa.array(took)
                cols = [pa.array(tree, pa.int32()), pa.array(shard), pa.array(block), part.column(0).take(took), part.column(1).take(took), as_bytes(x, kind).take(took), pa.array(leaves, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["tree", "shard", "block", "query_id", "query_print", "x", "leaves"])

    return run


FOUND = "query_id long, query_print long, vec_ids array<long>, prints array<long>, scores array<double>"


def _lists(heads: list[pa.Array], rows: np.ndarray, n: int, values: list[np.ndarray]) -> pa.Table:
    """One row for each head that has values; rows says to which head each value belongs."""
    ends = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v)) for v in values]
    out = pa.Table.from_arrays([*heads, *lists], names=["query_id", "query_print", "vec_ids", "prints", "scores"])
    return out.filter(pa.array(np.diff(ends) > 0))


def _meet(k: int, kind: str):
    """Queries and vectors of one shard -> each query's k best classes in the leaves that it opens there."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            empty = np.zeros(0, np.int64)
            return _lists([pa.array(empty)] * 2, empty, 0, [empty, empty, empty.astype(float)])
        leaf = rows["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        x, ids, prints = matrix(rows["x"], kind)[order], rows["vec_id"].to_numpy()[order], rows["print"].to_numpy()[order]
        leaves, starts = np.unique(leaf[order], return_index=True)
        ends = np.append(starts[1:], len(ids))
        out = []
        for at in range(0, queries.num_rows, 256):
            part = queries.slice(at, 256).combine_chunks()
            q = matrix(part["x"], kind)
            opened = [np.frombuffer(b, np.int64) for b in part["leaves"].to_pylist()]
            who, which = np.repeat(np.arange(len(q)), [len(o) for o in opened]), np.concatenate(opened)
            scores = np.full((len(q), len(ids)), -np.inf)
            for name, start, end in zip(leaves, starts, ends, strict=True):
                of = who[which == name]
                if len(of):
                    scores[of, start:end] = q[of] @ x[start:end].T
            r, c = best_of(scores, ids, k)
            out.append(_lists([part["query_id"].combine_chunks(), part["query_print"].combine_chunks()], r, len(q), [ids[c], prints[c], scores[r, c]]))
        return pa.concat_tables(out)

    return run


def _merge(k: int):
    """All that the shards found for a query class -> its k best classes, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, rows, values = [], [], ([], [], [])
            for i, found in enumerate(batch.column(2).to_pylist()):
                ids, prints, scores = (np.concatenate([np.array(f[c]) for f in found]) for c in ("vec_ids", "prints", "scores"))
                order = np.lexsort((prints, ids, -scores))
                ids, prints, scores = ids[order], prints[order], scores[order]
                _, first = np.unique(np.stack((ids, prints)), axis=1, return_index=True)
                first = np.sort(first)[:k]
                for out, v in zip(values, (ids[first], prints[first], scores[first]), strict=True):
                    out.append(v)
                rows.append(np.full(len(first), i))
            if rows:
                heads = [batch.column(0), batch.column(1)]
                yield from _lists(heads, np.concatenate(rows), batch.num_rows, [np.concatenate(v) for v in values]).to_batches()

    return run


def _brute(probes: np.ndarray, own: np.ndarray, k: int, forest: Forest, most: float, kind: str):
    """A partition's k best for every probe by brute force, its own class left out, with their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, prints = matrix(batch.column(2), kind), batch.column(1).to_numpy()
            scores = probes @ x.T
            scores[own[:, None] == prints] = -np.inf
            r, c = best_of(scores, batch.column(0).to_numpy(), k)
            leaves = forest.leaf(directions(x[c], most)).T
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(scores[r, c]), batch.column(0).take(pa.array(c)), pa.array(leaves.tolist(), pa.list_(pa.int64()))], names=["probe", "score", "vec_id", "leaves"])

    return run


def _budget(reps: DataFrame, forest: Forest, counts: np.ndarray, most: float, k: int, probes: int, recall: float, kind: str) -> int:
    """Rows that a search has to open so that the probes find `recall` of their neighbours."""
    picked = reps.filter("is_query").orderBy(F.xxhash64("print"), "vec_id").limit(probes).select("print", "x").toArrow()
    if not picked.num_rows:
        return 0
    x, own = matrix(picked["x"], kind), picked["print"].to_numpy()
    near = reps.select("vec_id", "print", "x").mapInArrow(_brute(x, own, k, forest, most, kind), "probe long, score double, vec_id long, leaves array<long>")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).select("probe", "leaves").toPandas()  # k rows a probe
    ways, found = asked_way(x), []
    for probe, g in near.groupby("probe"):
        found.append(forest.reached(ways[probe], counts, np.array(g["leaves"].tolist()).T))
    return int(np.quantile(np.concatenate(found), recall, method="higher")) + 1 if found else 1


def _search(good: DataFrame, width: int, kind: str, k: int, trees: int, leaf_rows: int, most_depth: int, shard_rows: int, sample_rows: int, probes: int, recall: float) -> DataFrame:
    """The search among vectors of one length."""
    spark = good.sparkSession
    light = good.select("vec_id", "print", "print2", "is_query")
    groups = light.groupBy("print", "print2").agg(F.min("vec_id").alias("class_id"), F.max("is_query").alias("asks"), F.count(F.lit(1)).alias("n"))
    several = materialize(groups.filter("n > 1"), "nn-classes")
    twins = light.join(broadcast_if_small(several, several.count(), 48), ["print", "print2"]).select("vec_id", "print", "print2", "is_query", "class_id", "asks").distinct()
    twins = materialize(twins, "nn-twins")
    # A class stands where its smallest id stands, once.
    others = twins.select("vec_id", "print", "print2", "class_id", "asks")
    reps = good.join(broadcast_if_small(others, twins.count(), 64), ["vec_id", "print", "print2"], "left").filter("class_id IS NULL OR class_id = vec_id")
    reps = reps.select("vec_id", "print", "print2", "x", F.coalesce("asks", "is_query").alias("is_query"), F.col("class_id").isNotNull().alias("twin"))
    again = reps.filter("twin").dropDuplicates(["vec_id", "print", "print2"])  # rows that repeat both id and vector
    reps = materialize(reps.filter("NOT twin").union(again).select("vec_id", "print", "x", "is_query"), "nn-vectors")

    n, most = reps.agg(F.count(F.lit(1)), F.max(F.expr("sqrt(aggregate(x, 0D, (a, c) -> a + double(c) * double(c)))"))).first()
    depth = min(most_depth, max(0, math.ceil(math.log2(n / leaf_rows))))
    sample = matrix(reps.orderBy(F.xxhash64("print"), "vec_id").limit(sample_rows).select("x").toArrow()["x"], kind)
    forest = Forest(directions(sample, most), trees, depth)
    while forest.known < depth:
        _grow(reps.select("print", "x"), n, forest, most, kind, sample_rows)
    counts = np.zeros((trees, 1 << depth), np.int64)
    for r in reps.select("x").mapInArrow(_count(forest, most, kind), "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["tree"], r["leaf"]] = r["n"]
    budget = _budget(reps, forest, counts, most, k, probes, recall, kind)
    layout = Layout(counts, shard_rows)

    filed = reps.select("vec_id", "print", "x").mapInArrow(_file(forest, layout, most, kind), "tree int, shard long, block long, vec_id long, print long, leaf long, x binary")
    queries = reps.filter("is_query").select("vec_id", "print", "x").repartition(parts(spark), "vec_id")
    asked = queries.mapInArrow(_ask(forest, layout, counts, budget, k + 1, kind), "tree int, shard long, block long, query_id long, query_print long, x binary, leaves binary")
    place = ["tree", "shard", "block"]
    found = asked.groupBy(*place).cogroup(filed.groupBy(*place)).applyInArrow(_meet(k + 1, kind), FOUND)
    merged = found.groupBy("query_id", "query_print").agg(F.collect_list(F.struct("vec_ids", "prints", "scores")).alias("found")).mapInArrow(_merge(k + 1), FOUND)
    best = merged.select("query_id", "query_print", F.inline(F.arrays_zip("vec_ids", "prints", "scores"))).select("query_id", "query_print", F.col("vec_ids").alias("vec_id"), F.col("prints").alias("print"), F.col("scores").alias("score"))

    # Classes of several rows: the k + 1 smallest ids as results, and every asking row as a query. The rank's limit works before the shuffle.
    rank = Window.partitionBy("class_id", "print").orderBy("vec_id")
    named = twins.select("class_id", "print", "vec_id").distinct().withColumn("at", F.row_number().over(rank)).filter(F.col("at") <= k + 1)
    named = named.groupBy("class_id", "print").agg(F.collect_list("vec_id").alias("ids"))
    m = several.count()
    best = best.join(broadcast_if_small(named.withColumnRenamed("class_id", "vec_id"), m, 60 + 8 * k), ["vec_id", "print"], "left")
    best = best.select("query_id", "query_print", "score", F.explode(F.coalesce("ids", F.array("vec_id"))).alias("vec_id"))
    askers = twins.filter("is_query").select(F.col("class_id").alias("query_id"), F.col("print").alias("query_print"), F.col("vec_id").alias("asker"))
    single = best.join(broadcast_if_small(several.select(F.col("class_id").alias("query_id"), F.col("print").alias("query_print")), m, 32), ["query_id", "query_print"], "left_anti")
    rows = single.select("query_id", "vec_id", "score").union(best.join(askers, ["query_id", "query_print"]).select("asker", "vec_id", "score"))
    return rows.filter("vec_id <> query_id")


def neighbours(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, trees: int = 3, leaf_rows: int = 256, most_depth: int = 20,
    shard_rows: int = 16_384, sample_rows: int = 20_000, probes: int = 256, recall: float = 0.94,
) -> DataFrame:
    """query_id, rank, vec_id, score. is_query is a condition on the column vec_id."""
    spark, x = vectors.sparkSession, F.col("x")
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    number, kind = ("float", "<f4") if single else ("double", "<f8")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    plain = F.transform(F.col(vector_col), lambda c: c.cast(number) + F.lit(0.0).cast(number))  # no negative zeros
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), plain.alias("x")).filter(F.col("vec_id").isNotNull() & x.isNotNull() & sound)
    good = good.select("vec_id", "x", F.xxhash64("x").alias("print"), F.xxhash64(F.lit(1), "x").alias("print2"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    widths = [r["n"] for r in good.groupBy(F.size("x").alias("n")).count().orderBy("n").collect()]  # a row for each length that occurs
    out = None
    for width in widths:
        part = _search(good.filter(F.size("x") == width), width, kind, k, trees, leaf_rows, most_depth, shard_rows, sample_rows, probes, recall)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], RESULT)
    # One deal of the rows serves both the choice of an id's best score and the ranking.
    once = out.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
