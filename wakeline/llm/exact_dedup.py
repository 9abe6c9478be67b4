"""Exact dedup by Golomb-coded fingerprint exchange (operator 5).

1. Every input partition ("sender") hashes its normalised texts (JVM SHA-256) and keeps the leading 64 bits of each as fingerprint.
2. A sender sorts its distinct fingerprints and sends each owner (a range of fingerprints) one Golomb-Rice coded block.
3. The owner merges its blocks and answers every sender with a bitmap: bit i is set if fingerprint i of that block is
   also known elsewhere. A sender adds the repeats among its own rows. These rows are suspects.
4. Only suspects' texts are shuffled, and Spark's hash aggregation on the whole normalised text compares them byte by byte;
   partial aggregation folds a large group of copies before the shuffle.

Defined results: a null text counts as empty; empty texts are equal to each other; repeated rows of an id are rows of their
own and count in group_size (all of them share keep_id, and every row with the id that stays is marked kept); an empty table gives no rows;
further columns are ignored, whatever their names. A null id sorts after every other id. Very long texts are compared whole; of equally long
ones (a tie) the smaller id stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, broadcast_if_small, materialize, parts


# ---------------------------------------------------------------- Golomb-Rice code of sorted 64-bit numbers
def rice_encode(values: np.ndarray, low: int, span_bits: int) -> bytes:
    """Sorted distinct uint64 values >= low from a range of 2**span_bits.

    1 byte for k, 4 for the count, 8 for the bits of the unary part; then d >> k of every gap d in unary (that many ones, then a zero), and after
    these the k low bits of every gap. With the two parts apart, neither way needs a loop over the gaps.
    """
    n = len(values)
    if n == 0:
        return b"\0" + bytes(12)
    gaps = np.diff(values, prepend=np.uint64(low)).astype(np.uint64)
    k = max(0, min(63, span_bits - max(1, n).bit_length()))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    tails = np.empty((n, k), np.uint8)
    for j in range(k):
        tails[:, j] = ((gaps >> np.uint64(k - 1 - j)) & np.uint64(1)).astype(np.uint8)
    return bytes([k]) + n.to_bytes(4, "little") + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(tails.ravel()).tobytes()


def rice_decode(block: bytes, low: int) -> np.ndarray:
    k, n, bits = block[0], int.from_bytes(block[1:5], "little"), int.from_bytes(block[5:13], "little")
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    middle = 13 + -(-bits // 8)
    stops = np.flatnonzero(np.unpackbits(np.frombuffer(block, np.uint8, middle - 13, 13), count=bits) == 0)
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        tails = np.unpackbits(np.frombuffer(block, np.uint8, offset=middle), count=n * k).reshape(n, k)
        for j in range(k):
            gaps |= tails[:, j].astype(np.uint64) << np.uint64(k - 1 - j)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


def _owner_bits(owners: int) -> int:
    return max(1, math.ceil(math.log2(max(2, owners))))


def _blocks(owner_bits: int):
    """Rows of senders -> one block for each sender and owner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for pdf in batches:
            for sender, g in pdf.groupby("sender"):
                held.setdefault(int(sender), []).append(g["fp"].to_numpy(np.int64).view(np.uint64))
        shift = np.uint64(64 - owner_bits)
        for sender, pieces in held.items():
            fps = np.unique(np.concatenate(pieces))
            owner = (fps >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            out = [(int(o[0]), sender, rice_encode(f, int(o[0]) << (64 - owner_bits), 64 - owner_bits)) for o, f in zip(np.split(owner, cuts), np.split(fps, cuts), strict=True)]
            yield pd.DataFrame(out, columns=["owner", "sender", "block"])

    return run


def _answer(owner_bits: int):
    """All blocks of an owner -> a bitmap for each of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(pdf["owner"].iloc[0]) << (64 - owner_bits)
        lists = [rice_decode(b, low) for b in pdf["block"]]
        values, counts = np.unique(np.concatenate(lists), return_counts=True)
        repeated = values[counts > 1]
        bitmaps = [np.packbits(np.isin(x, repeated, assume_unique=True)).tobytes() for x in lists]
        return pd.DataFrame({"sender": pdf["sender"], "owner": pdf["owner"], "bitmap": bitmaps})

    return run


def _mark(owner_bits: int):
    """A sender's own rows and the bitmaps it received -> its suspects' fingerprints, each once."""

    def run(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
        fps, counts = np.unique(rows["fp"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        hit = counts > 1
        owner = (fps >> np.uint64(64 - owner_bits)).astype(np.int64)
        for o, bitmap in zip(bitmaps["owner"], bitmaps["bitmap"], strict=True):
            at = np.flatnonzero(owner == o)
            hit[at] |= np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), count=len(at)).astype(bool)
        return pd.DataFrame({"fp": fps[hit].view(np.int64)})

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_owner: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Most code points in the original text wins, then the smallest id."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, SPACES, "")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("raw"), norm.alias("norm")).select("doc_id", "norm", F.char_length("raw").cast("long").alias("n_cp"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    fp = F.shiftleft(F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"), 4).bitwiseOR(F.conv(F.substring("sha", 16, 1), 16, 10).cast("long"))
    light = materialize(rows.select(F.spark_partition_id().alias("sender"), "doc_id", "n_cp", "sha", fp.alias("fp")), "dedup-prints")
    n = light.count()
    bits = _owner_bits(parts(spark, n, rows_per_owner))

    prints = light.select("sender", "fp")
    by_sender = prints.repartition("sender")
    blocks = by_sender.mapInPandas(_blocks(bits), "owner long, sender int, block binary")
    bitmaps = blocks.groupBy("owner").applyInPandas(_answer(bits), "sender int, owner long, bitmap binary")
    suspects = prints.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(_mark(bits), "fp long").distinct()
    suspects = materialize(suspects, "dedup-suspects")
    m = suspects.count()

    # Byte verification: suspects only, grouped by their whole text.
    keyed = rows.withColumn("fp", fp)
    text_rows = keyed.join(broadcast_if_small(suspects, m, 16), "fp", "left_semi")
    best = F.struct((-F.col("n_cp")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"))
    groups = text_rows.groupBy("norm").agg(F.min("sha").alias("sha"), F.count(F.lit(1)).alias("group_size"), F.min(best).alias("best")).select("sha", "group_size", F.col("best.doc_id").alias("keep_id"))
    groups = groups.filter("group_size > 1").groupBy("sha").agg(F.min("group_size").alias("group_size"), F.min("keep_id").alias("keep_id"), F.count(F.lit(1)).alias("texts"))
    groups = groups.withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share one SHA-256"))))

    # A large group is one key of many rows: those of at least `hot` rows (no more than 1000 of them) are dealt to many tasks.
    groups = materialize(groups, "dedup-groups")
    hot = groups.filter(F.col("group_size") > max(5000, n // 1000)).select(F.col("sha").alias("hot_sha"))
    salts = F.when(F.col("hot_sha").isNotNull(), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))
    owners = groups.join(F.broadcast(hot), F.col("sha") == F.col("hot_sha"), "left").withColumn("salt", F.explode(salts)).drop("hot_sha", "texts")
    dealt = light.join(F.broadcast(hot), F.col("sha") == F.col("hot_sha"), "left").withColumn("salt", F.when(F.col("hot_sha").isNotNull(), F.pmod(F.xxhash64("doc_id", "n_cp", "sender"), F.lit(64))).otherwise(0).cast("int")).drop("hot_sha")
    out = dealt.join(owners, ["sha", "salt"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("sha").alias("text_sha256"))
