"""Quality classifier by compression (operator 4).

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text is compressed whole, block by block, with each;
the difference of the two sizes, as a share of the text's bytes, tells which of the two it resembles. A logistic curve fitted on other
labelled documents turns the difference into a probability.

Bounded samples (parameters): of each class the `per_class` labelled ids with the smallest hash train the dictionary, through at most
`blocks_per_class` blocks of their text, and the next `per_class` fit the curve. Everything else covers all rows.

Defined results: a null text counts as empty, whose difference is the prior alone; with labels of one class or none there is nothing to
compare, and every score is the share of good labels (1 without any); repeated rows are scored once a row; an empty table gives no
rows; labels that are null or neither 0 nor 1 are ignored; very long texts are compressed whole, block by block; a score of just the threshold counts
as good; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_batches

BLOCK = 4096
#: Bytes by which the difference is moved towards good: a very short text says little either way.
PRIOR_BYTES = 8.0
#: Differences beyond this share of the text are all equally clear.
CLEAR = 0.3


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    prior: float


def _sizes(model: CompressionModel):
    """A function from text to its normalised size difference."""
    import zstandard

    packers = []
    for data in (model.good, model.bad):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=3)
        packers.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(text: str) -> float:
        data = text.encode("utf-8", "surrogatepass")
        good = bad = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            good += len(packers[0].compress(block))
            bad += len(packers[1].compress(block))
        return float(np.clip((bad - good + PRIOR_BYTES) / (len(data) + 4 * PRIOR_BYTES), -CLEAR, CLEAR))

    return difference


def _measure(model: CompressionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference = _sizes(model)
        for batch in batches:
            values = pa.array([difference(t) for t in batch.column(batch.schema.names.index("text")).to_pylist()], pa.float64())
            keep = [i for i, n in enumerate(batch.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), "difference"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and offset of a one-variable logistic curve, by Newton steps with halving."""
    scale = float(np.std(x)) or 1.0
    design = np.column_stack((x / scale, np.ones_like(x)))
    beta = np.zeros(2)

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + ridge * b[0] ** 2 / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        grad = design.T @ (weight * (p - y)) + ridge * beta * [1, 0]
        hess = (design * (weight * p * (1 - p) + 1e-12)[:, None]).T @ design + ridge * np.diag([1.0, 1e-9])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(0.0, beta[0]) / scale), float(beta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2000, blocks_per_class: int = 4000, dictionary_bytes: int = 112_640) -> CompressionModel:
    import zstandard

    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 1.0
    if len(counts) < 2:
        return CompressionModel(b"", b"", 0.0, 0.0, prior)
    chosen = []
    for label in (0, 1):  # at most 4 * per_class ids come to the driver
        ids = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class).collect()
        half = min(per_class, max(1, len(ids) // 2))
        chosen += [(r["doc_id"], label, int(i >= half)) for i, r in enumerate(ids)]
    sample = spark.createDataFrame(chosen, "s_id long, label int, part int")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("s_id"))

    # Dictionaries: whole texts as blocks, of which a bounded number per class comes to the driver.
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(BLOCK))
    blocks = texts.filter("part = 0").select("label", "doc_id", "text", F.explode(starts).alias("at")).select("label", "doc_id", "at", F.expr(f"substring(text, at, {BLOCK})").alias("block"))
    dictionaries = []
    for label in (1, 0):
        rows = blocks.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(blocks_per_class).select("block").collect()
        data = [r["block"].encode("utf-8", "surrogatepass") for r in rows]
        data = [x for x in data if len(x) >= 8] or [b"        "]
        try:
            dictionaries.append(zstandard.train_dictionary(min(dictionary_bytes, max(256, sum(map(len, data)) // 4)), data).as_bytes())
        except zstandard.ZstdError:  # too little text to train on: the text itself serves as dictionary
            dictionaries.append(b"".join(data)[-dictionary_bytes:])
    model = CompressionModel(*dictionaries, 0.0, 0.0, prior)
    rows = texts.filter("part = 1").select("label", "text").mapInArrow(_measure(model), "label int, difference double").collect()
    if len({r["label"] for r in rows}) < 2:
        return CompressionModel(b"", b"", 0.0, 0.0, prior)
    y = np.array([r["label"] for r in rows], float)
    x = np.array([r["difference"] for r in rows], float)
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))  # the sample is balanced, the labels are not
    slope, offset = logistic(x, y, weight)
    return CompressionModel(*dictionaries, slope, offset, prior)


def score_quality(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, difference: one row per input row."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not model.good:
        scored = rows.select("doc_id", "held_out", F.lit(0.0).alias("difference"), F.lit(float(model.prior)).alias("score"))
    else:
        kind = rows.schema["doc_id"].dataType.simpleString()
        scored = rows.mapInArrow(_measure(model), f"doc_id {kind}, held_out boolean, difference double")
        scored = scored.withColumn("score", 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("difference") + F.lit(model.offset)))))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "difference")


def keep_good(docs: DataFrame, model: CompressionModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the threshold. Nothing is shuffled."""
    text_batches(docs.sparkSession)
    if not model.good:
        return docs if model.prior >= threshold else docs.filter("false")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        difference = _sizes(model)
        for batch in batches:
            values = np.array([difference(t or "") for t in batch.column(batch.schema.names.index(text_col)).to_pylist()])
            yield batch.filter(pa.array(1 / (1 + np.exp(-(model.slope * values + model.offset))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
