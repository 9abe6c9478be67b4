"""Substring dedup with compressed FM-indexes (operator 10).

Remove every word that lies in a window of `window` words whose sequence also starts anywhere else.

1. Every window is filed under its minimizer: of the `gram`-word sequences in it, the one of least hash. Neighbouring windows with one
   minimizer form a run; equal windows lie in runs of equal minimizers, wherever they occur.
2. Runs are counted by minimizer and content. A run whose minimizer is found nowhere else, and only once in itself, has no repeated
   window and is let go. Of all others every different content goes once to a shard of its minimizer, with a mark if it occurs several times.
3. A shard indexes its contents (those that are marked count twice) with an FM-index: suffix array, Burrows-Wheeler transform, and a wavelet
   matrix of bit vectors with two levels of counts, a quarter of a bit more a bit. All its contents are streamed through backward search: from a
   right end, the search goes left as long as what it has matched occurs at least twice. The matching statistic so found, where it
   reaches the window length, is a repeated interval; where a search fails, the windows that hold what it has read are unique.
4. Intervals go back to all runs of their content, are joined, and cover words.

A minimizer with very many different contents (`crowded`) is cut once more, by minimizers of longer sequences, and these at last by
whole windows, so that no shard grows without bound; the pieces go through the same index.

Words are compared as 64-bit hashes and contents as 128-bit hashes of these; nothing else is approximate.

Defined results: null texts have no words; texts shorter than a window lose nothing; a repetition inside one document counts; repeated rows of an
id are documents of their own, whose windows repeat each other; very long texts are read whole, like any other; places that tie (equal windows)
all lose their words, none is kept; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_sized, materialize, parts, text_batches

P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
P2 = np.uint64(0xD6E8FEB86659FD93)
KEY = ["minimizer", "content", "check"]


class WordHashes(dict):
    """Word -> 64-bit hash; forgets everything when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(29))) * Q
    return a ^ (a >> np.uint64(32))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive numbers."""
    a = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        a = a * P + h[i : len(h) - k + 1 + i]
    return mixed(a)


def window_minimum(a: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values, by doubling."""
    width, out = 1, a
    while 2 * width <= k:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    if width < k:
        shift = k - width
        out = np.minimum(out[:-shift], out[shift:])
    return out


def content_hash(h: np.ndarray, p: np.uint64, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(h), p, np.uint64))), dtype=np.uint64)
    back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(len(h), np.uint64(pow(int(p), -1, 1 << 64)), np.uint64))), dtype=np.uint64)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(h * power[:-1], dtype=np.uint64)))
    return mixed((sums[starts + sizes] - sums[starts]) * back[starts] + sizes.astype(np.uint64))


def runs_of(h: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of many documents whose word hashes h stand one behind the other.

    Of each run: document, start in it, number of windows, minimizer, two hashes of its content, and whether it may repeat itself.
    """
    none = np.zeros(0, np.int64)
    nothing = (none, none, none, *[none.astype(np.uint64)] * 3, none.astype(bool))
    if len(h) < window:
        return nothing
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    span, grams = window - gram + 1, rolling(h, gram)
    least = window_minimum(grams, span)  # one value a window
    inside = np.arange(len(least)) + window <= ends[doc[: len(least)]]
    at = np.flatnonzero(inside)
    if not len(at):
        return nothing
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (least[at[1:]] != least[at[:-1]]))))
    starts, counts = at[first], np.diff(np.concatenate((first, [len(at)])))
    values, docs = least[starts], doc[starts]
    # Content hashes by prefix sums of h[i] * p**i, scaled back to the start of the run.
    content, check = (content_hash(h, p, starts, counts - 1 + window) for p in (P, P2))
    # A place holds a minimizer if, of the windows around it, one has its hash as minimum; no window there has a larger one. Where two
    # places of one minimizer are near each other, a window may repeat inside the run.
    edge = np.zeros(span - 1, np.uint64)
    highest = ~window_minimum(~np.concatenate((edge, np.where(inside, least, np.uint64(0)), edge)), span)
    places = np.flatnonzero(highest == grams)
    twice = (grams[places[1:]] == grams[places[:-1]]) & (np.diff(places) <= span)
    key = lambda value, d: mixed(value + d.astype(np.uint64) * P)
    own = np.isin(key(values, docs), key(grams[places[1:]][twice], doc[places[1:]][twice])) if twice.any() else np.zeros(len(values), bool)
    return docs, starts - (ends - lengths)[docs], counts, values, content, check, own


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words of each document and the digest of all of them."""
    for batch in batches:
        words = [words_of(t) for t in batch.column(2).to_pylist()]
        digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(digests)], names=["key", "doc_id", "n_words", "digest"])


def _runs(window: int, gram: int, words_at_once: int = 500_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        keys: list[int] = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            docs, starts, counts, values, contents, checks, own = runs_of(np.concatenate(held), np.array([len(x) for x in held]), window, gram)
            cols = (np.array(keys, np.int64)[docs], starts.astype(np.int32), counts.astype(np.int32), values.view(np.int64), contents.view(np.int64), checks.view(np.int64), own)
            keys.clear(), held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "start", "count", *KEY, "own"])

        n = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if len(words) >= window:
                    keys.append(key), held.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                    n += len(words)
                if n >= words_at_once:
                    yield out()
                    n = 0
        if held:
            yield out()

    return run


class FMIndex:
    """FM-index of a text of small numbers over 1..sigma-1; 0 ends every document. weight: how often the document of each place occurs."""

    def __init__(self, text: np.ndarray, depth: int, weight: np.ndarray | None = None):
        self.n, self.sigma = len(text), int(text.max()) + 1
        suffix = self._suffixes(text, depth)
        self.upto = np.concatenate(([0], np.cumsum(np.ones(self.n, np.int32) if weight is None else weight[suffix], dtype=np.int32)))
        bwt = text[suffix - 1]  # the symbol before each suffix; before the first, the last end mark
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        # Wavelet matrix: from the highest bit down, zeros before ones. Ones are counted before every 65,536th place, and from there before
        # every 64th in 16 bits.
        self.bits, self.words, self.far, self.near, self.zeros = max(1, (self.sigma - 1).bit_length()), [], [], [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = ((level >> b) & 1).astype(np.uint8)
            padded = np.zeros(-(-(self.n + 1) // 64) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            far = before[::1024].copy()
            self.words.append(words)
            self.far.append(far)
            self.near.append((before - far[np.arange(len(before)) >> 10]).astype(np.uint16))
            self.zeros.append(int(self.n - bit.sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    @staticmethod
    def _suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        """Suffixes in the order of their first `depth` symbols or more, by doubling: all that searches of that length can tell apart."""
        rank, n, k = text.astype(np.int64), len(text), 1
        while True:
            second = np.zeros(n, np.int64)
            second[: n - k] = rank[k:] + 1
            key = rank * (int(rank.max()) + 2) + second
            order = np.argsort(key)
            new = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
            rank = np.empty(n, np.int64)
            rank[order] = new
            k *= 2
            if k >= depth or new[-1] == n - 1 or k >= n:
                return order

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        inside = self.words[level][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.far[level][word >> 10] + self.near[level][word] + np.bitwise_count(inside)

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search for many intervals at once; both their ends go through the levels together."""
        both, symbols = np.concatenate((low, high)), np.concatenate((symbol, symbol))
        for level in range(self.bits):
            ones = self._rank1(level, both)
            both = np.where(symbols & (1 << (self.bits - 1 - level)), self.zeros[level] + ones, both - ones)
        # Both are now places among equal symbols of the matrix's last level; count from the symbol's first.
        both += (self.below[: self.sigma] - self._first())[symbols]
        return both[: len(low)], both[len(low) :]

    def _first(self) -> np.ndarray:
        """Where each symbol starts in the matrix's last level."""
        if not hasattr(self, "_starts"):
            every = np.arange(self.sigma)
            low = np.zeros(self.sigma, np.int64)
            for level in range(self.bits):
                ones = self._rank1(level, low)
                low = np.where(every & (1 << (self.bits - 1 - level)), self.zeros[level] + ones, low - ones)
            self._starts = low
        return self._starts

    def matching(self, text: np.ndarray, ends: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Matching statistics: for each right end (exclusive), how many symbols up to it, its `most` at most, occur at least twice."""
        out, most = np.zeros(len(ends), np.int64), np.broadcast_to(most, len(ends))
        live = np.flatnonzero(most > 0)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        length = 0
        while len(live):
            length += 1
            symbol = text[ends[live] - length]
            low, high = self.step(low, high, symbol)
            on = (self.upto[high] - self.upto[low] >= 2) & (symbol > 0)
            out[live[on]] = length
            on &= most[live] > length
            live, low, high = live[on], low[on], high[on]
        return out


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, lens: np.ndarray, window: int, most: int = 64) -> list[np.ndarray]:
    """For each content (start and length in text): which of its windows occur again.

    What is not known yet is a stretch of windows from `low` to `high`. A search from its right end settles at once all windows at the end of a
    repeated interval; a search from the end of its first window, where it fails at some word, settles all windows from there up to that word,
    as they hold what was found to be unique. The stretch shrinks from both sides until nothing is left.
    """
    counts = lens - window + 1
    pieces = -(-counts // most)  # long contents are searched in several stretches at once
    owner = np.repeat(np.arange(len(lens)), pieces)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * most
    origin, known = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), bool)
    base, offset = starts[owner], origin[owner]
    at, low, high = np.arange(len(owner)), first, np.minimum(first + most, counts[owner]) - 1
    while len(at):
        end = high + window
        found = index.matching(text, base[at] + end, end - low)
        hit = found >= window
        edge = np.zeros(len(known) + 1, np.int32)
        np.add.at(edge, offset[at[hit]] + (end - found)[hit], 1)
        np.add.at(edge, offset[at[hit]] + (end - window)[hit] + 1, -1)
        known |= np.cumsum(edge[:-1]) > 0
        high = np.where(hit, end - found - 1, high - 1)
        on = low <= high
        at, low, high = at[on], low[on], high[on]
        if not len(at):
            break
        end = low + window
        found = index.matching(text, base[at] + end, window)
        hit = found >= window
        known[offset[at[hit]] + low[hit]] = True
        low = np.where(hit, low + 1, end - found)
        on = low <= high
        at, low, high = at[on], low[on], high[on]
    return np.split(known, np.cumsum(counts)[:-1])


def _search(window: int):
    """All contents of one shard -> which windows of each occur again (a bit mask as bytes)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [np.frombuffer(t, np.uint64) for t in pdf["words"]]
        lens = np.array([len(t) for t in texts])
        _, symbols = np.unique(np.concatenate(texts), return_inverse=True)
        text, ends = np.zeros(int(lens.sum()) + len(lens), np.int64), np.cumsum(lens + 1)
        text[np.arange(len(symbols)) + np.repeat(np.arange(len(lens)), lens)] = symbols + 1
        # A content that occurs several times counts twice wherever it is found.
        index = FMIndex(text, min(int(lens.max()), 64 + window), np.repeat(np.where(pdf["several"], 2, 1), lens + 1))
        masks = repeated_windows(index, text, ends - lens - 1, lens, window)
        return pdf[KEY].assign(mask=[np.packbits(m).tobytes() for m in masks])

    return run


def _cut(window: int):
    """The word hashes of asked runs, read from the text once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.array([hashes[w] for w in words_of(text)], np.uint64)
                for r in runs:
                    rows.append((*(r[c] for c in KEY), r["several"], h[r["start"] : r["start"] + r["count"] - 1 + window].tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[*KEY, "several", "words"])

    return run


PIECE = "minimizer long, content long, check long, several boolean, words binary"


def _recut(window: int, gram: int):
    """Contents of a crowded minimizer -> their parts by minimizers of longer sequences, each with its place in the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [np.frombuffer(t, np.uint64) for t in batch.column(4).to_pylist()]
            if not texts:
                continue
            flat, lens = np.concatenate(texts), np.array([len(t) for t in texts])
            docs, starts, counts, values, contents, checks, _ = runs_of(flat, lens, window, gram)
            firsts = np.cumsum(lens) - lens
            parts_of = [flat[firsts[d] + s : firsts[d] + s + n - 1 + window].tobytes() for d, s, n in zip(docs, starts, counts, strict=True)]
            roots = [batch.column(c).take(pa.array(docs)) for c in range(4)]
            cols = [*roots, pa.array(starts), pa.array(counts), pa.array(values.view(np.int64)), pa.array(contents.view(np.int64)), pa.array(checks.view(np.int64)), pa.array(parts_of, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["r_minimizer", "r_content", "r_check", "r_several", "start", "count", *KEY, "words"])

    return run


RECUT = "r_minimizer long, r_content long, r_check long, r_several boolean, start long, count long, minimizer long, content long, check long, words binary"


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """The masks of a content's parts, put together."""
    pdf = pdf.sort_values("start")
    bits = [np.unpackbits(np.frombuffer(m, np.uint8), count=n) for m, n in zip(pdf["mask"], pdf["count"], strict=True)]
    root = pdf[["r_minimizer", "r_content", "r_check"]].iloc[:1].set_axis(KEY, axis=1)
    return root.assign(mask=[np.packbits(np.concatenate(bits)).tobytes()])


def find_repeats(pieces: DataFrame, window: int, grams: list[int], crowded: int, shard_runs: int) -> DataFrame:
    """KEY and mask of every content. Crowded minimizers are cut by the next longer sequences first; grams ends with the window itself."""
    spark = pieces.sparkSession
    if grams:
        kinds = pieces.groupBy("minimizer").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > crowded).select("minimizer")
        kinds = materialize(kinds, "sub-crowded")
        few = kinds.count()
        if few:
            many = broadcast_if_small(kinds, few, 16)
            parts_of = materialize(pieces.join(many, "minimizer", "left_semi").select(*KEY, "several", "words").mapInArrow(_recut(window, grams[0]), RECUT), "sub-recut")
            again = parts_of.groupBy(*KEY).agg(F.first("words").alias("words"), ((F.count(F.lit(1)) > 1) | F.max("r_several")).alias("several"), F.count(F.lit(1)).alias("size"))
            again = materialize(again, "sub-parts")
            found = find_repeats(again.select(*KEY, "several", "words"), window, grams[1:], crowded, shard_runs)
            masks = materialize(found.join(again.select(*KEY, "size"), KEY), "sub-part-masks")
            whole = join_sized(parts_of.drop("words"), masks, KEY, "size", parts_of.count())
            composed = whole.select("r_minimizer", "r_content", "r_check", "start", "count", "mask").groupBy("r_minimizer", "r_content", "r_check").applyInPandas(_compose, "minimizer long, content long, check long, mask binary")
            return composed.union(find_repeats(pieces.join(many, "minimizer", "left_anti").select(*KEY, "several", "words"), window, [], crowded, shard_runs))
    shards = parts(spark, pieces.count(), shard_runs)
    shard = F.pmod(F.xxhash64("minimizer"), F.lit(shards)).alias("shard")
    return pieces.select(shard, *KEY, "several", "words").groupBy("shard").applyInPandas(_search(window), "minimizer long, content long, check long, mask binary")


def _keep(window: int):
    """Remove the words that repeated windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests, spans = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                for r in found:
                    at = np.flatnonzero(np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=r["count"]))
                    np.add.at(edge, r["start"] + at, 1)
                    np.add.at(edge, r["start"] + at + window, -1)
                covered = np.cumsum(edge[:-1]) > 0
                removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(b" ".join(w for w, c in zip(words, covered, strict=True) if not c)).hexdigest())
                spans.append(np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(digests), pa.array(spans, pa.list_(pa.int64()))], names=["key", "n_removed", "kept_sha256", "spans"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 14, crowded: int = 4096, shard_runs: int = 16_384) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256, spans (removed words: start, end, start, end ...)."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    unique = ids["n"] == ids["known"] and rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
    # Ids may repeat or be null; then rows of one id and text share a key, and with it their fate.
    texts = rows.withColumn("key", F.col("doc_id") if unique else F.xxhash64("doc_id", "text"))
    light = materialize(texts.select("key", "doc_id", "text").mapInArrow(_count, "key long, doc_id long, n_words long, digest string"), "sub-light")
    runs = texts.select("key", "text").mapInArrow(_runs(window, gram), "key long, start int, count int, minimizer long, content long, check long, own boolean")
    runs = materialize(runs, "sub-runs")

    # Contents of minimizers that occur more than once; of each the place with the smallest key that has it.
    contents = runs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("times"), F.max("own").alias("own"))
    often = contents.groupBy("minimizer").agg(F.sum("times").alias("runs"), F.max("own").alias("some_own")).filter("runs > 1 OR some_own").select("minimizer")
    again = materialize(contents.join(often, "minimizer").select(*KEY, "times"), "sub-contents")
    marked = join_sized(runs.select("key", "start", "count", *KEY), again, KEY, "times", runs.count())
    suspects = materialize(marked.groupBy(*KEY).agg(F.first("times").alias("times"), F.min(F.struct("key", "start", "count")).alias("at")), "sub-suspects")
    run = F.struct(F.col("at.start").alias("start"), F.col("at.count").alias("count"), *KEY, (F.col("times") > 1).alias("several"))
    by_doc = materialize(suspects.select(F.col("at.key").alias("key"), run.alias("r")).groupBy("key").agg(F.collect_list("r").alias("runs")), "sub-asked")
    some = broadcast_if_small(by_doc.select("key"), by_doc.count(), 24)
    sources = texts.select("key", "text").join(some, "key", "left_semi")
    if not unique:
        sources = sources.dropDuplicates(["key"])
    pieces = materialize(sources.join(by_doc, "key").select("text", "runs").mapInArrow(_cut(window), PIECE), "sub-pieces")

    middle = (gram + window) // 2
    masks = find_repeats(pieces, window, [*([middle] if gram < middle < window else []), window], crowded, shard_runs)
    masks = masks.filter(F.length(F.replace(F.hex("mask"), F.lit("0"))) > 0)
    masks = materialize(masks.join(suspects.select(*KEY, "times"), KEY), "sub-masks")
    found = join_sized(runs.select("key", "start", "count", *KEY), masks, KEY, "times", runs.count())
    found = found.select("key", F.struct("start", "count", "mask").alias("f")).groupBy("key").agg(F.collect_list("f").alias("found"))
    found = materialize(found, "sub-found")
    some = broadcast_if_small(found.select("key"), found.count(), 24)
    sources = texts.select("key", "text").join(some, "key", "left_semi")
    if not unique:
        sources = sources.dropDuplicates(["key"])
    kept = sources.join(found, "key").select("key", "text", "found").mapInArrow(_keep(window), "key long, n_removed long, kept_sha256 string, spans array<long>")
    out = light.join(kept, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "digest").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))
