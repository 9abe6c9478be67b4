"""N-gram Jaccard join in metric space (operator 2).

Jaccard distance d = 1 - |x & y| / |x | y| is a metric; two documents link when d <= e (e = 0.25 by default). No pair is lost at any step:

1. Documents with equal shingle sets are one class; its smallest id stands for it. Copies cost nothing further on.
2. Sieve. Of every set take the part H that lies below a fixed hash bound. A link leaves at most a quarter of x outside y, so at least
   |x & H| - |x| / 4 shingles of that part occur in another class. Classes below that count link with nothing. Shingles are exchanged as
   packed blocks by hash range; shingles that repeat inside a sender are folded before they are sent.
3. Pivots. In any order of all shingles, linked sets share one of their first |x| - ceil(3/4 |x|) + 1. Frequent shingles come last in the order.
   Of the classes that share such a shingle, the one of smallest hash is the pivot, and the region of a pivot is every class that shares a leading
   shingle with it: regions overlap, and every linked pair lies together in one.
4. Inside a region, recursively: a pivot is measured against the classes that the triangle inequality leaves, |d(x, p) - d(y, p)| <= e for every
   earlier pivot p. Those within e are its Voronoi core and are linked at once, never with each other; the next pivot is a class outside all
   cores. Last, cores of different pivots are joined in the windows around their borders.
5. A region too large for one task is first measured against its pivot in blocks. The core is linked; what can still link beyond it (the
   rest, and the core's rim d(x, p) >= min d(rest, p) - e) goes on, in pairs of blocks if it is still too large.
6. Links are stars of region components, so a group of n copies makes n - 1 links; connected components do the rest.

Distances between documents without common text are all 1, so pivots drawn at random would bound nothing; drawing them from shared leading
shingles is what makes the regions small.

Defined results: null texts and texts without words have an empty set and link with nothing; fewer words than a shingle make one shingle
of all of them; repeated rows of an id are copies, and an id at several texts links by each of them; very long texts are shingled whole; an empty table gives no rows; further columns are ignored,
whatever their names; rows without an id are left out of links and are their own component (null). Of ids that tie for a class or a component
the smallest stands for it.

Shingles are compared as hashes: 64 bits of each, 48 inside regions, where a pair of sets of 500 shingles has a chance of one in a billion
of counting one shingle too many; classes as 128 bits of all of a set's hashes. Nothing else is approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_sized, materialize, parts, text_batches
from .components import connected_components

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Word -> 64-bit hash; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 120_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(29))) * Q
    return a ^ (a >> np.uint64(32))


def shingle_set(text: str | None, width: int, words_hash: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words_hash.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    a = h[: len(h) - k + 1] + np.uint64(k)
    for i in range(1, k):
        a = a * P + h[i : len(h) - k + 1 + i]
    return np.unique(mixed(a))


def pack48(s: np.ndarray) -> bytes:
    """Leading 48 bits of each hash, 6 bytes apiece, still in order."""
    return np.ascontiguousarray((s >> np.uint64(16)).astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def needed(n: np.ndarray | int, percent: int):
    """Shingles that a set of n shares with any set that it links with."""
    return -(-n * percent // 100)


def _light(width: int, bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sizes, below, digests = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width, words)
                sizes.append(len(s))
                below.append(int(np.searchsorted(s, np.uint64(bound))))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(below, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "n", "n_below", "digest"])
        pa.default_memory_pool().release_unused()

    return run


def _exchange(width: int, bound: int, buckets: int, flush: int = 1_000_000):
    """Blocks for the owners of hash ranges: low 40 bits of each shingle, its class, and counts already settled here."""
    step = bound // buckets + 1

    def blocks(ids: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(sets)
        docs = np.repeat(np.array(ids, np.int64), [len(s) for s in sets])
        order = np.argsort(hashes, kind="stable")
        hashes, docs = hashes[order], docs[order]
        first = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        again = ~first | np.concatenate((~first[1:], [False]))
        known, counts = np.unique(docs[again], return_counts=True)
        send_docs = np.where(again, np.int64(-1), docs)[first]  # one row for a shingle that repeats here; -1: shared already
        send = hashes[first]
        bucket = (send // np.uint64(step)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        rows = []
        for b, h, d in zip(np.split(bucket, cuts), np.split(send, cuts), np.split(send_docs, cuts), strict=True):
            by_doc = np.argsort(d, kind="stable")
            low = np.ascontiguousarray(h[by_doc].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append((int(b[0]), low.tobytes(), d[by_doc].tobytes(), b"", b""))
        if len(known):
            rows.append((int(bucket[0]), b"", b"", known.tobytes(), counts.astype(np.int64).tobytes()))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "low", "docs", "known", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, sets, held = WordHashes(), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(text, width, words)
                s = s[: np.searchsorted(s, np.uint64(bound))]
                if len(s):
                    ids.append(doc), sets.append(s)
                    held += len(s)
                if held >= flush:
                    yield from blocks(ids, sets)
                    ids, sets, held = [], [], 0
        if sets:
            yield from blocks(ids, sets)

    return run


def _settle(groups: int):
    """All blocks of one hash range -> how many shingles of each class occur in another class too, packed by groups of classes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, total = shared_counts(pdf)
        group = (mixed(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        ids, total, group = ids[order], total[order], group[order]
        cuts = np.flatnonzero(np.diff(group)) + 1
        rows = [(int(g[0]), i.tobytes(), t.tobytes()) for g, i, t in zip(np.split(group, cuts), np.split(ids, cuts), np.split(total, cuts), strict=True) if len(g)]
        return pd.DataFrame(rows, columns=["group", "ids", "counts"])

    return run


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """All packed counts of a group of classes -> one row a class."""
    ids, at = np.unique(np.frombuffer(b"".join(pdf["ids"]), np.int64), return_inverse=True)
    return pd.DataFrame({"doc_id": ids, "shared": np.bincount(at, weights=np.frombuffer(b"".join(pdf["counts"]), np.int64)).astype(np.int64)})


def shared_counts(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    low = np.frombuffer(b"".join(pdf["low"]), np.uint8).reshape(-1, 5)
    wide = np.zeros((len(low), 8), np.uint8)
    wide[:, :5] = low
    h = wide.view("<u8").ravel()
    docs = np.frombuffer(b"".join(pdf["docs"]), np.int64)
    order = np.argsort(h, kind="stable")
    h, docs = h[order], docs[order]
    start = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    shared = ~start | np.concatenate((~start[1:], [False])) if len(h) else start
    docs = docs[shared]
    known = np.frombuffer(b"".join(pdf["known"]), np.int64)
    counts = np.frombuffer(b"".join(pdf["counts"]), np.int64)
    ids, at = np.unique(np.concatenate((docs[docs >= 0], known)), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate((np.ones(int((docs >= 0).sum())), counts)), minlength=len(ids))
    return ids, total.astype(np.int64)


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, width, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([pack48(s) for s in sets], pa.binary())], names=["doc_id", "n", "shingles"])
        pa.default_memory_pool().release_unused()

    return run


def _leading(percent: int, frequent: np.ndarray):
    """The leading shingles of each set in the order (frequent last, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = unpack48(data)
                if len(frequent):
                    at = np.searchsorted(frequent, s)
                    late = frequent[np.minimum(at, len(frequent) - 1)] == s
                    s = np.concatenate((s[~late], s[late]))
                s = s[: len(s) - needed(len(s), percent) + 1]
                ids.append(np.full(len(s), doc, np.int64)), out.append(s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(ids))], names=["shingle", "doc_id"])

    return run


class Region:
    """The classes of one region, and the exact recursive join of them."""

    def __init__(self, docs: np.ndarray, sets: list[np.ndarray], percent: int):
        order = np.argsort(mixed(docs.astype(np.uint64) * P), kind="stable")
        self.docs, self.sets = docs[order], [sets[i] for i in order]
        self.n = np.array([len(s) for s in self.sets], np.int64)
        self.flat, self.ends = np.concatenate(self.sets), np.cumsum(self.n)
        self.percent, self.e = percent, 1 - percent / 100 + 1e-9
        self.comp = np.arange(len(docs))
        self.core = np.full(len(docs), -1)
        self.measured: list[np.ndarray] = []  # distances to each pivot so far, NaN where not measured

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        pivot, n = self.sets[i], self.n[others]
        ends = np.cumsum(n)
        items = self.flat[np.repeat((self.ends - self.n)[others] - ends + n, n) + np.arange(ends[-1])]
        at = np.searchsorted(pivot, items)
        hit = pivot[np.minimum(at, len(pivot) - 1)] == items
        return np.add.reduceat(hit, ends - n)

    def others(self, i: int, pool: np.ndarray) -> np.ndarray:
        """Those of pool that may link with i: another component, near in size, and inside every window."""
        pool = pool[(self.comp[pool] != self.comp[i]) & (100 * np.minimum(self.n[pool], self.n[i]) >= self.percent * np.maximum(self.n[pool], self.n[i]))]
        for d in self.measured:
            if not len(pool):
                break
            if not np.isnan(d[i]):
                pool = pool[~(np.abs(d[pool] - d[i]) > self.e)]
        return pool

    def measure(self, i: int, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        common = self.common(i, pool)
        union = self.n[i] + self.n[pool] - common
        linked = pool[100 * common >= self.percent * union]
        for c in np.unique(self.comp[linked]):
            self.comp[self.comp == c] = self.comp[i]
        return 1 - common / union, linked

    def links(self) -> list[tuple[int, int]]:
        every = np.arange(len(self.docs))
        for i in every:
            if self.core[i] >= 0:
                continue
            pool = self.others(i, every)
            d = np.full(len(every), np.nan)
            d[i] = 0.0
            if len(pool):
                d[pool], linked = self.measure(i, pool)
                self.core[linked[self.core[linked] < 0]] = i
            self.measured.append(d)
        cores = np.flatnonzero(self.core >= 0)
        if len(np.unique(self.comp[cores])) > 1:
            for k, i in enumerate(cores):
                pool = self.others(i, cores[k + 1 :])
                if len(pool):
                    self.measure(i, pool)
        out = []
        for c in np.unique(self.comp):
            members = self.docs[self.comp == c]
            out += [(int(members.min()), int(m)) for m in members if m != members.min()]
        return out


def _join_region(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("doc_id")
        region = Region(pdf["doc_id"].to_numpy(np.int64), [unpack48(s) for s in pdf["shingles"]], percent)
        return pd.DataFrame(region.links(), columns=["a", "b"]).astype("int64")

    return run


def _to_pivot(percent: int):
    """Distance of every row of a large region to its pivot, whose set came along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            common = np.array([len(np.intersect1d(unpack48(a), unpack48(b), assume_unique=True)) for a, b in zip(pdf["shingles"], pdf["pivot_shingles"], strict=True)], np.int64)
            n, m = pdf["shingles"].str.len().to_numpy(np.int64) // 6, pdf["pivot_shingles"].str.len().to_numpy(np.int64) // 6
            union = n + m - common
            yield pd.DataFrame({"pivot": pdf["pivot"], "doc_id": pdf["doc_id"], "d": 1 - common / union, "core": 100 * common >= percent * union})

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, frequent_above: int = 32, most_frequent: int = 4_000_000, region_rows: int = 1024, block_shingles: int = 1_000_000) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, and class_id (the smallest id with the same set)."""
    spark = docs.sparkSession
    text_batches(spark)
    bound = int(0.4 * 2**64)
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    light = materialize(text.mapInArrow(_light(width, bound), "doc_id long, n long, n_below long, digest binary"), "jaccard-light")
    usable = light.filter("n > 0 AND doc_id IS NOT NULL")
    if _repeats(usable.select("doc_id", "digest").distinct()):
        how = {"width": width, "percent": percent, "frequent_above": frequent_above, "most_frequent": most_frequent, "region_rows": region_rows, "block_shingles": block_shingles}
        return _by_row(text, **how)
    classes = materialize(usable.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("n_below").alias("n_below"), F.count(F.lit(1)).alias("rows")), "jaccard-classes")
    n_classes, postings = classes.agg(F.count(F.lit(1)), F.sum("n_below")).first()
    postings = postings or 0

    # Sieve.
    reps = broadcast_if_small(classes.select(F.col("class_id").alias("doc_id")), n_classes, 24)
    buckets = parts(spark, postings, block_shingles)
    texts = text.filter("doc_id IS NOT NULL").join(reps, "doc_id", "left_semi")
    blocks = texts.mapInArrow(_exchange(width, bound, buckets), "bucket int, low binary, docs binary, known binary, counts binary")
    shared = blocks.groupBy("bucket").applyInPandas(_settle(buckets), "group long, ids binary, counts binary").groupBy("group").applyInPandas(_total, "doc_id long, shared long")
    may_link = F.coalesce("shared", F.lit(0)) >= F.col("n_below") - (F.col("n") - F.ceil(F.col("n") * percent / 100))
    kept = classes.select(F.col("class_id").alias("doc_id"), "n", "n_below").join(shared, "doc_id", "left").filter(may_link).select("doc_id")
    kept = materialize(kept, "jaccard-kept")
    left = broadcast_if_small(kept, kept.count(), 24)
    sets = text.filter("doc_id IS NOT NULL").join(left, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, n long, shingles binary")
    sets = materialize(sets.dropDuplicates(["doc_id"]) if _repeats(usable) else sets, "jaccard-sets")

    # Pivots from shared leading shingles; frequent shingles last.
    frequent = np.zeros(0, np.uint64)
    for _ in range(3):
        leading = sets.select("doc_id", "shingles").mapInArrow(_leading(percent, frequent), "shingle long, doc_id long")
        counts = leading.groupBy("shingle").count().filter(F.col("count") > frequent_above)
        new = counts.orderBy(F.desc("count"), "shingle").limit(most_frequent // 4).select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64)
        grown = np.union1d(frequent, new)
        if len(grown) == len(frequent):
            break
        frequent = grown
    leading = materialize(sets.select("doc_id", "shingles").mapInArrow(_leading(percent, frequent), "shingle long, doc_id long"), "jaccard-leading")
    by_hash = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("doc_id"))
    cells = leading.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min(by_hash).alias("least")).filter("k > 1").select("shingle", F.col("least.doc_id").alias("pivot"))
    members = materialize(leading.join(cells, "shingle").select("pivot", "doc_id").distinct(), "jaccard-members")

    # Regions: small ones in one task each, large ones around their pivot first.
    sizes = materialize(members.groupBy("pivot").count(), "jaccard-sizes")
    n_members = members.count()
    tagged = join_sized(members, sizes, ["pivot"], "count", n_members)
    small = tagged.filter((F.col("count") > 1) & (F.col("count") <= region_rows)).join(sets, "doc_id").select("pivot", "doc_id", "shingles")
    links = materialize(small.groupBy("pivot").applyInPandas(_join_region(percent), "a long, b long"), "jaccard-links")
    large = tagged.filter(F.col("count") > region_rows).select("pivot", "doc_id")
    if not large.isEmpty():
        wide = sizes.filter(F.col("count") > region_rows)
        pivots = materialize(sets.select(F.col("doc_id").alias("pivot"), F.col("shingles").alias("pivot_shingles")).join(wide, "pivot"), "jaccard-pivots")
        rows = join_sized(large.join(sets, "doc_id").select("pivot", "doc_id", "shingles"), pivots, ["pivot"], "count", n_members)
        measured = materialize(rows.mapInPandas(_to_pivot(percent), "pivot long, doc_id long, d double, core boolean"), "jaccard-measured")
        nearest = measured.filter("NOT core").groupBy("pivot").agg(F.min("d").alias("nearest"), F.count(F.lit(1)).alias("rest"))
        rim = measured.join(nearest, "pivot").filter(~F.col("core") | (F.col("d") >= F.col("nearest") - (1 - percent / 100) - 1e-9))
        rim = materialize(rim.select("pivot", "doc_id"), "jaccard-rim")
        counted = rim.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")).withColumn("blocks", F.ceil(F.col("m") / F.when(F.col("m") > region_rows, region_rows // 2).otherwise(region_rows)).cast("int"))
        own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
        with_block = rim.join(counted, "pivot").withColumn("own", own)
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"))))
        paired = with_block.select("pivot", "doc_id", pair.alias("p")).select("pivot", "doc_id", "p.i", "p.j").join(sets, "doc_id").select("pivot", "i", "j", "doc_id", "shingles")
        rest = paired.groupBy("pivot", "i", "j").applyInPandas(_join_region(percent), "a long, b long")
        links = materialize(links.union(measured.filter("core").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))).union(rest), "jaccard-links")

    found = materialize(connected_components(links), "jaccard-components")
    of_class = classes.join(found, F.col("class_id") == F.col("node"), "left").select("digest", "class_id", F.coalesce("component", "class_id").alias("component"), "rows")
    # Rows in some class get its component; a class of very many copies is dealt to many tasks. All others stand alone.
    in_class = F.col("n") > 0, F.col("doc_id").isNotNull()
    named = join_sized(light.filter(in_class[0] & in_class[1]).select("digest", "doc_id", "n"), materialize(of_class, "jaccard-named"), ["digest"], "rows", light.count())
    named = named.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "class_id")
    alone = light.filter(~(in_class[0] & in_class[1])).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    return named.union(alone)


def _by_row(text: DataFrame, **how) -> DataFrame:
    """For ids that stand at several texts: every row is a document, joined under a number of its own and named by its id afterwards."""
    rows = materialize(text.withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    found = materialize(jaccard_components(rows, "row", "text", **how).withColumnRenamed("doc_id", "row"), "jaccard-by-row")
    found = materialize(rows.select("row", "doc_id").join(found, "row"), "jaccard-named-rows")
    n = found.count()
    for name in ("component_id", "class_id"):
        least = materialize(found.groupBy(name).agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows")), "jaccard-least")
        found = join_sized(found, least, [name], "_rows", n).drop(name, "_rows").withColumnRenamed("_least", name)
    return found.select("doc_id", "n_shingles", "component_id", "class_id")


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
