"""Language identification with error-correcting output codes (operator 9).

Every language has a codeword of +1 and -1. One binary classifier a bit, logistic on hashed counts of letter n-grams, predicts the bits
of a text; a text gets the language whose codeword has the least total loss over the bits. The losses are weighted: a bit counts for a
language by how reliably its classifier gets that language's sampled texts right. Where the two best are close the result is flagged as ambiguous.

Every language with a labelled text gets a codeword. Bounded sample (parameter): of each language the `per_lang` labelled documents with
the smallest hash, whole texts, turned into n-gram counts by the executors. Everything else covers all rows and whole texts. A sample up
to DENSE_BYTES is trained on the driver; for a larger one the executors sum the gradients of the same steps from the sparse counts.

Defined results: `und` with score 0 for null texts and texts without a letter; with no labelled text at all every text is `und`; with one language
every text with a letter is that language; repeated rows are predicted once a row; an empty table gives no rows; further columns
are ignored, whatever their names; equal losses go to the first language in code point order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, held_out, materialize, parts, text_batches

BITS = 13
UNDETERMINED = "und"
#: The largest dense matrix of sampled rows that the driver holds.
DENSE_BYTES = 400_000_000
#: Places of a gradient that are summed together.
BLOCK = 128


class Grams:
    """Counts of the 1-, 2- and 3-grams of a text's letters, hashed to 2**BITS places, as a vector of length one."""

    def __init__(self) -> None:
        self.letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)

    def __call__(self, text: str) -> np.ndarray | None:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = self.letter[codes]
        if not is_letter.any():
            return None
        codes = np.where(is_letter, codes, np.uint32(32))
        codes = np.concatenate((np.array([32], np.uint32), codes, np.array([32], np.uint32)))
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]  # one gap between words
        one = codes * np.uint32(2654435761)
        two = (one[:-1] ^ (codes[1:] * np.uint32(2246822519) + np.uint32(1))) * np.uint32(3266489917)
        three = (two[:-1] ^ (codes[2:] * np.uint32(668265263) + np.uint32(3))) * np.uint32(374761393)
        at = np.concatenate((one, two, three)) >> np.uint32(32 - BITS)
        counts = np.log1p(np.bincount(at, minlength=1 << BITS).astype(np.float32))
        return counts / np.linalg.norm(counts)


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """n rows of +1 and -1, far apart. All columns for a few languages, else the best of many random codes of 15 * log2(n) bits."""
    if n <= 5:
        columns = [[1 if (c >> i) & 1 else -1 for i in range(n)] for c in range(1, 1 << (n - 1))] or [[1] * n]
        return np.array(columns, float).T
    rng, width = np.random.default_rng(seed), int(np.ceil(15 * np.log2(n)))
    best, far = None, -1
    for _ in range(50 if n <= 2000 else 3):
        code = rng.choice([-1.0, 1.0], (n, width))
        worst = width
        for at in range(0, n, 1000):  # so that no square of all languages is held
            same = code[at : at + 1000] @ code.T
            same[np.arange(len(same)), np.arange(at, at + len(same))] = -width
            worst = min(worst, int((width - same.max()) // 2))
        if worst > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, worst
    return best


@dataclass(frozen=True)
class LanguageModel:
    """trust: languages by bits, how far a bit's classifier can be relied on for texts of a language (rows add up to the number of bits)."""

    langs: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    offsets: np.ndarray
    trust: np.ndarray


def _descend(n: int, bits: int, gradient, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """All bits' logistic classifiers at once, by accelerated gradient descent. gradient(w, b): sums over all n rows, for weights and offsets."""
    w, b = np.zeros((1 << BITS, bits), np.float32), np.zeros(bits, np.float32)
    w_old, b_old, rate = w, b, 4.0 / (1 + ridge)
    for t in range(steps):
        m = t / (t + 3)
        wl, bl = w + m * (w - w_old), b + m * (b - b_old)
        gw, gb = gradient(wl, bl)
        w_old, b_old = w, b
        w = wl - rate * (gw + ridge / n * wl)
        b = bl - rate * gb
    return w.astype(np.float32), b.astype(np.float32)


def _pull(x: np.ndarray, target: np.ndarray, w: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    return -target / (1 + np.exp(np.clip(target * (x @ w + b), -50, 50))) / n


def train_bits(x: np.ndarray, target: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """x: rows by places, on the driver; target: rows by bits, +1 or -1."""

    def gradient(w, b):
        pull = _pull(x, target, w, b, len(x))
        return x.T @ pull, pull.sum(0)

    return _descend(len(x), target.shape[1], gradient, ridge, steps)


def train_bits_sparse(rows: DataFrame, n: int, langs: list[str], code: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """The same steps with the n sampled rows (lang, places, counts) left on the executors; the driver gets one gradient a step."""
    context, at = rows.sparkSession.sparkContext, {lang: i for i, lang in enumerate(langs)}
    fixed = context.broadcast((at, code.astype(np.float32)))

    def gradient(w, b):
        now = context.broadcast((w.astype(np.float32), b.astype(np.float32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (index, words), (wl, bl) = fixed.value, now.value
            gw, gb = np.zeros_like(wl), np.zeros_like(bl)
            for batch in batches:
                for first in range(0, batch.num_rows, 256):
                    part = batch.slice(first, 256)
                    x = np.zeros((part.num_rows, 1 << BITS), np.float32)
                    for i, (places, counts) in enumerate(zip(part.column(1), part.column(2), strict=True)):
                        x[i, places.values.to_numpy()] = counts.values.to_numpy()
                    pull = _pull(x, words[[index[v] for v in part.column(0).to_pylist()]], wl, bl, n)
                    gw += x.T @ pull
                    gb += pull.sum(0)
            blocks = [gw[i : i + BLOCK].tobytes() for i in range(0, len(gw), BLOCK)] + [gb.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "sums"])

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(v, np.float32) for v in pdf["sums"]], axis=0, dtype=np.float32)
            return pdf.iloc[:1].assign(sums=[total.tobytes()])

        got = dict(rows.mapInArrow(run, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary").collect())
        now.unpersist()
        parts = [np.frombuffer(got[i], np.float32) for i in range(len(got))]
        return np.concatenate(parts[:-1]).reshape(w.shape), parts[-1]

    return _descend(n, code.shape[1], gradient, ridge, steps)


def reliability(right: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of the loss: for each language, the share of its sampled texts whose bit comes out right, beyond chance, made to average 1."""
    share = (right + 1) / (counts[:, None] + 2)
    weight = np.maximum(share - 0.5, 0.02)
    return weight / weight.mean(1, keepdims=True)


def _hits(weights: np.ndarray, offsets: np.ndarray, code: np.ndarray, langs: list[str]):
    """A partition's sampled texts by language, and how many of them each bit's classifier puts on the right side."""
    at = {lang: i for i, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, counts = np.zeros(code.shape, np.int64), np.zeros(len(langs), np.int64)
        for batch in batches:
            for lang, places, values in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                i = at[lang]
                margin = values.values.to_numpy() @ weights[places.values.to_numpy()] + offsets
                right[i] += margin * code[i] > 0
                counts[i] += 1
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([langs[i] for i in seen], pa.string()), pa.array(counts[seen]), pa.array(right[seen].tolist(), pa.list_(pa.int64()))], names=["lang", "n", "hits"])

    return run


def trusted(rows: DataFrame, langs: list[str], code: np.ndarray, weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """reliability of every bit for every language, from the sampled rows; a row a language reaches the driver."""
    each = rows.mapInArrow(_hits(weights, offsets, code, langs), "lang string, n long, hits array<long>")
    sums = each.groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(F.element_at("hits", i + 1)).alias(f"h{i}") for i in range(code.shape[1])]).collect()
    at, right, counts = {lang: i for i, lang in enumerate(langs)}, np.zeros(code.shape), np.zeros(len(langs))
    for r in sums:
        right[at[r["lang"]]], counts[at[r["lang"]]] = [r[f"h{i}"] for i in range(code.shape[1])], r["n"]
    return reliability(right, counts)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for batch in batches:
        langs, places, values = [], [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (v := grams(text)) is not None:
                at = np.flatnonzero(v)
                langs.append(lang), places.append(at.astype(np.int32)), values.append(v[at])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["lang", "places", "counts"])


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400) -> LanguageModel:
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # Of a language's hashes only those below a bound that leaves about twice per_lang of them are ranked, so no task sees a whole language.
    light = known.select("lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("at"))
    share = light.groupBy("lang").agg((2.0 * per_lang / F.count(F.lit(1)) + 0.0).alias("share"), F.count(F.lit(1)).alias("rows"))
    share = materialize(share, "language-shares")
    low = light.join(broadcast_if_small(share, share.count(), 64), "lang").filter((F.col("rows") <= 8 * per_lang) | (F.col("at") < F.col("share") * F.lit(1 << 40)))
    order = Window.partitionBy("lang").orderBy("at", "doc_id")
    picks = low.select("lang", "doc_id", F.row_number().over(order).alias("n")).filter(F.col("n") <= per_lang)
    chosen = materialize(picks.select(F.col("lang").alias("s_lang"), F.col("doc_id").alias("s_id")), "language-picks")
    chosen = broadcast_if_small(chosen, chosen.count(), 64)
    texts = known.join(chosen, (F.col("doc_id") == F.col("s_id")) & (F.col("lang") == F.col("s_lang")))
    rows = materialize(texts.select("lang", "text").mapInArrow(_sparse, "lang string, places array<int>, counts array<float>"), "language-rows")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    langs, n = sorted(sizes), sum(sizes.values())
    if len(langs) < 2:
        return LanguageModel(tuple(langs), np.ones((len(langs), 1)), np.zeros((1 << BITS, 1), np.float32), np.zeros(1, np.float32), np.ones((len(langs), 1)))
    code = codewords(len(langs))
    if n * (4 << BITS) > DENSE_BYTES:
        spread = materialize(rows.repartition(parts(docs.sparkSession, n, 20_000)), "language-rows")
        fitted = train_bits_sparse(spread, n, langs, code)
        return LanguageModel(tuple(langs), code, *fitted, trusted(spread, langs, code, *fitted))
    found, at = rows.collect(), {lang: i for i, lang in enumerate(langs)}
    x = np.zeros((n, 1 << BITS), np.float32)
    for i, r in enumerate(found):
        x[i, r["places"]] = r["counts"]
    fitted = train_bits(x, code[[at[r["lang"]] for r in found]].astype(np.float32))
    return LanguageModel(tuple(langs), code, *fitted, trusted(rows, langs, code, *fitted))


def decode(model: LanguageModel, bits: np.ndarray) -> tuple[int, float, float]:
    """The language with the least loss, its share against the others, and its lead over the second, from the bits' margins.

    The loss of a language is the sum over the bits of log(1 + exp(-codeword bit * margin)), each weighted by the trust in that bit for it.
    """
    loss = (model.trust * np.logaddexp(0, -model.code * bits)).sum(1)
    p = np.exp(loss.min() - loss)
    p /= p.sum()
    best = int(np.argmin(loss))
    lead = float(np.partition(loss, 1)[1] - loss[best]) if len(loss) > 1 else float("inf")
    return best, float(p[best]), lead


def _predict(model: LanguageModel, near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            langs, scores, doubts = [], [], []
            for text in batch.column(2).to_pylist():
                v = grams(text) if text is not None and model.langs else None
                if v is None:
                    found = (UNDETERMINED, 0.0, True)
                else:
                    best, score, lead = decode(model, v @ model.weights + model.offsets)
                    found = (model.langs[best], score, lead < near)
                for out, value in zip((langs, scores, doubts), found, strict=True):
                    out.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubts, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", near: float = 0.5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: one row per input row."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(model, near), f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
