"""Source divergence audit by in-mapper stripes (operator 12).

How far do the words of each source of a language lie from those of every other source, and which terms make it stand out?

* Fold. A task folds whole documents into hash stripes: (lang, term) -> document frequency, and a count for each source. When the stripes
  of a task hold `entries` numbers they are spilled as rows, and new ones are begun, so memory is bounded and a frequent word is one row a
  spill, however often it occurs.
* Merge. Stripes are dealt by (lang, term), sorted, and equal keys are merged while they stream by. Terms in fewer than `least` documents go.
* Emit. From merged stripes come the totals of each source (N) and the size of each vocabulary (V). Then every stripe emits its divergences:
  to each task go some buckets of a language's stripes, after the totals of that language. It sums each pair of sources over its stripes, and
  keeps the `top` terms of each source. Pairs of counts that are both 0 add the same for each term, so they are multiplied instead of visited.

All arithmetic is exact: p = 1 + floor(10^9 * (count + 1) / (N + V)), f = floor((p - q)^2 / q), in 64-bit integers where they suffice, else in
Python's.

Defined results: null text, lang and source are ''; texts without terms still make their group occur; a language without kept terms has pairs
of value 0 and no terms; a source alone in its language has no pairs; repeated rows count as documents of their own; an empty table gives no
rows; further columns are ignored, whatever their names. Counts above 2^63 - 1 fail the job. A task holds the totals and the pair sums of one
language, 8 bytes for each pair of its sources, which is what the result has rows for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_batches

SCALE = 10**9
#: UTF-8 bytes of terms, A-Z lower-cased; all others become blanks. Bytes from 128 on are parts of longer code points.
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STRIPE = "lang string, term string, docs long, sources array<string>, counts array<long>"
_STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
FOUND = "lang string, source string, part string, item string, value long"
_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_OUT_ROWS = 10_000


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), _OUT_ROWS):
        columns = zip(*rows[i : i + _OUT_ROWS], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _spilled(stripes: dict[str, dict[bytes, dict]]) -> Iterator[pa.RecordBatch]:
    for lang, of in stripes.items():
        items = iter(of.items())
        while some := list(islice(items, _OUT_ROWS)):
            docs = [stripe.pop(None) for _, stripe in some]
            sources, counts = [s for _, stripe in some for s in stripe], [c for _, stripe in some for c in stripe.values()]
            ends = np.cumsum([0, *(len(stripe) for _, stripe in some)], dtype=np.int32)
            term = pa.array([t for t, _ in some], pa.binary()).cast(pa.string())
            yield _stripe_batch(pa.array([lang] * len(some)), term, np.array(docs), ends, pa.array(sources, pa.string()), np.array(counts, np.int64))


def _stripe_batch(lang: pa.Array, term: pa.Array, docs: np.ndarray, ends: np.ndarray, sources: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    """ends: where each stripe's sources end, after a 0."""
    at = pa.array(ends, pa.int32())
    return pa.RecordBatch.from_arrays([lang, term, pa.array(docs, pa.int64()), pa.ListArray.from_arrays(at, sources), pa.ListArray.from_arrays(at, pa.array(counts))], schema=_STRIPE)


def folded(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """lang, source, text -> stripes. A stripe keeps its document frequency under None."""
    stripes: dict[str, dict[bytes, dict]] = {}
    held = 0
    for batch in batches:
        lang, source, text = batch.columns
        for name, origin, raw in zip(lang.to_pylist(), source.to_pylist(), text.cast(pa.binary()).to_pylist(), strict=True):
            of = stripes.setdefault(name, {})
            for term, n in Counter(terms(raw)).items():
                stripe = of.get(term)
                if stripe is None:
                    of[term] = {None: 1, origin: n}
                    held += 2
                    continue
                stripe[None] += 1
                if origin in stripe:
                    stripe[origin] += n
                else:
                    stripe[origin] = n
                    held += 1
            if held >= entries:
                yield from _spilled(stripes)
                stripes, held = {}, 0
    yield from _spilled(stripes)


def merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Stripes in the order of their keys -> one stripe a key, if its term is in at least so many documents. The last key of a batch may go on in
    the next one, so its rows wait for that."""
    waiting = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if waiting is None else [*waiting.to_batches(), batch]).combine_chunks()
        if not table.num_rows:
            continue
        starts = _runs(table)
        waiting = table.slice(starts[-1])
        if len(starts) > 1:
            yield from _merge(table.slice(0, starts[-1]), starts[:-1], least)
    if waiting is not None:
        yield from _merge(waiting, np.zeros(1, np.int64), least)


def _runs(table: pa.Table) -> np.ndarray:
    """Where the runs of equal (lang, term) begin."""
    new = np.ones(table.num_rows, bool)
    changes = [pc.not_equal(c.slice(1), c.slice(0, table.num_rows - 1)).to_numpy(zero_copy_only=False) for c in (_whole(table["lang"]), _whole(table["term"]))]
    new[1:] = changes[0] | changes[1]
    return np.flatnonzero(new)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _merge(table: pa.Table, starts: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    docs = np.add.reduceat(table["docs"].to_numpy(), starts)
    kept = np.flatnonzero(docs >= least)
    if not len(kept):
        return
    rows = np.diff(np.append(starts, table.num_rows))
    some = table.take(pa.array(np.repeat(starts[kept] - np.cumsum(rows[kept]) + rows[kept], rows[kept]) + np.arange(rows[kept].sum())))
    lists, counts = _whole(some["sources"]), _whole(some["counts"])
    source = lists.flatten().dictionary_encode()
    names, code = source.dictionary, source.indices.to_numpy().astype(np.int64)
    stripe = np.repeat(np.repeat(np.arange(len(kept)), rows[kept]), np.asarray(pc.list_value_length(lists)))
    key, place = np.unique(stripe * len(names) + code, return_inverse=True)
    total = np.zeros(len(key), np.int64)
    np.add.at(total, place, counts.flatten().to_numpy())
    ends = np.searchsorted(key, np.arange(len(kept) + 1) * len(names)).astype(np.int32)
    first = pa.array(starts[kept])
    yield _stripe_batch(_whole(table["lang"]).take(first), _whole(table["term"]).take(first), docs[kept], ends, names.take(pa.array(key % len(names))), total)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (counts + 1) / total), exact. 10^9 is taken in two factors, so that products stay within 64 bits up to 2.8 * 10^14."""
    if total.size and int(total.max()) >= 2.8e14:
        return (1 + SCALE * (counts.astype(object) + 1) // total.astype(object)).astype(np.int64)
    whole, rest = np.divmod((counts + 1) * 31_250, total)
    return 1 + whole * 32_000 + rest * 32_000 // total


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Emitter:
    """Sums and keeps what the stripes of one language say."""

    def __init__(self, lang: str, names: list[str], sums: list[int], vocabulary: int, top: int) -> None:
        self.lang, self.top, self.vocabulary = lang, top, vocabulary
        self.names = names
        self.at = {s: i for i, s in enumerate(names)}
        self.total = np.array(sums, np.int64) + vocabulary
        self.whole = np.array([sum(sums) + vocabulary], np.int64)
        self.zero = shares(np.zeros(len(names), np.int64), np.maximum(self.total, 1))
        self.both_zero = excess(self.zero[:, None], self.zero[None, :])
        self.pairs = np.zeros((len(names), len(names)), np.int64)
        self.best: list[list[tuple[int, bytes]]] = [[] for _ in names]

    def add(self, stripes: list[tuple[str, list[str], list[int]]]) -> None:
        """stripes: term, sources, counts."""
        width = len(self.names)
        step = max(1, 200_000 // (width * width))
        for i in range(0, len(stripes), step):
            part = stripes[i : i + step]
            row = np.repeat(np.arange(len(part)), [len(s) for _, s, _ in part])
            col = np.array([self.at[s] for _, names, _ in part for s in names])
            count = np.array([c for _, _, found in part for c in found], np.int64)
            p = shares(count, self.total[col])
            dense = np.tile(self.zero, (len(part), 1))
            dense[row, col] = p
            absent = np.ones(dense.shape, bool)
            absent[row, col] = False
            # What each source with the term adds against all others, and what all without it add against it, beyond two zeros.
            np.add.at(self.pairs, col, excess(p[:, None], dense[row]) - self.both_zero[col])
            against = (excess(dense[row], p[:, None]) - self.both_zero[:, col].T) * absent[row]
            np.add.at(self.pairs.T, col, against)
            lang_count = np.zeros(len(part), np.int64)
            np.add.at(lang_count, row, count)
            q = shares(lang_count, np.broadcast_to(self.whole, lang_count.shape))[row]
            value = excess(p, q)
            for k in np.flatnonzero(p > q):
                self.best[col[k]].append((-int(value[k]), part[row[k]][0].encode()))
        for kept in self.best:
            if len(kept) > 4 * self.top:
                kept.sort()
                del kept[self.top :]

    def rows(self, first: bool) -> list[tuple]:
        """first: the two zeros of the whole vocabulary are added, by one task of the language only."""
        pairs = self.pairs + (self.both_zero * self.vocabulary if first else 0)
        n = len(self.names)
        out = [(self.lang, self.names[a], "pair", self.names[b], int(pairs[a, b])) for a in range(n) for b in range(n) if a != b]
        for name, kept in zip(self.names, self.best, strict=True):
            out += [(self.lang, name, "term", item.decode(), -value) for value, item in sorted(kept)[: self.top]]
        return out


def emitted(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """lang, bucket, vocabulary, term, sources, counts, sorted by lang and bucket, in each bucket the totals (no term) first."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for lang, group in groupby(rows, key=lambda r: r[0]):
        now, first, totals, stripes, size = None, False, {}, [], 0
        for _, bucket, size, term, sources, counts in group:
            first = first or bucket == 0
            if term is None:
                if now is None:
                    totals[sources[0]] = counts[0]
                continue
            if now is None:
                now = Emitter(lang, list(totals), list(totals.values()), size, top)
            stripes.append((term, sources, counts))
            if len(stripes) >= 4096:
                now.add(stripes)
                stripes = []
        if now is None:
            now = Emitter(lang, list(totals), list(totals.values()), size, top)
        now.add(stripes)
        yield from _batches(now.rows(first), _FOUND)


def divergences(docs: DataFrame, least: int = 3, top: int = 200, entries: int = 400_000, bucket_terms: int = 512) -> DataFrame:
    """docs: text, lang, source. Returns lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    text_batches(spark)
    blank = F.lit("")
    light = docs.select(*[F.coalesce(F.col(c).cast("string"), blank).alias(c) for c in ("lang", "source", "text")])
    stripes = light.mapInArrow(lambda b: folded(b, entries), STRIPE)
    stripes = stripes.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(lambda b: merged(b, least), STRIPE)
    stripes = materialize(stripes, "divergence-stripes")

    groups = light.select("lang", "source").distinct()
    each = stripes.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sizes = stripes.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"))
    totals = groups.join(each, ["lang", "source"], "left").join(sizes, "lang", "left")
    totals = materialize(totals.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("vocabulary", F.lit(0)).alias("vocabulary")), "divergence-totals")

    # Each bucket of a language gets the totals first: as many copies as the vocabulary has buckets.
    buckets = F.ceil(F.col("vocabulary") / bucket_terms)
    head = totals.filter("vocabulary > 0").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), buckets - 1)).alias("bucket"), "vocabulary", F.lit(None).cast("string").alias("term"),
        F.array("source").alias("sources"), F.array("n").alias("counts"),
    )
    body = stripes.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), buckets).alias("bucket"), "vocabulary", "term", "sources", "counts")
    dealt = head.unionByName(body).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", F.col("term").isNotNull(), F.element_at("sources", 1))
    found = materialize(dealt.mapInArrow(lambda b: emitted(b, top), FOUND), "divergence-found")

    # Sources of a language without kept terms have nothing to add up: their pairs are 0.
    bare = totals.filter("vocabulary = 0")
    other = bare.select("lang", F.col("source").alias("item"))
    silent = bare.select("lang", "source").join(other, "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).union(silent)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(found.filter("part = 'term'").select(*pairs.columns)).filter(F.col("rank") <= top))
