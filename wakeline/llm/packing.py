"""Best-fit packing of documents into sequences (operator 3).

A document is its token ids and one end id. Documents longer than a sequence are cut into pieces of full length; only they are cut.
Pieces go into sequences by vector best-fit decreasing under three capacities: tokens, documents, and attention cost (the sum
of squared lengths). Among the open sequences that can take a piece under every constraint, it goes to the one with

* rule "norm": the least weighted norm of what is left of the three capacities, each as a share of its whole, or
* rule "dot": the largest weighted dot product of the piece with what is left.

The capacity for documents must not cost sequences: it is found for each group. The group is packed by tokens alone first, then with twice
the mean number of documents a sequence as its capacity; where that takes more sequences, the first packing stays. A capacity that is given
holds as it is.

Pieces are dealt to groups of bounded size by a hash, and each group is packed alone: a group leaves at most about one poorly filled
sequence, one in some hundred or more. A group has about `rows_per_group` pieces, or `least_sequences` sequences where pieces are short. No task
grows with the input.

Tokens: the tokenizer encodes each of its pre-tokens on its own, so a text's ids are put together from those of its pre-tokens, each
distinct one encoded once a worker and kept in a bounded cache.

Defined results: a null or empty text is just its end id; repeated rows are packed once a row; an empty table gives no rows; further columns
are ignored, whatever their names; pieces of equal length come by id, then piece; of equally good sequences any one is taken, the same in every
run; a very long text becomes as many full pieces as it fills and one shorter.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# The tokenizer's own pre-tokens, spelt out for Latin-1 (whose texts are always in normal form C).
_L, _N, _S = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
PRE_TOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


class ChunkTokenizer(dict):
    """Token ids of whole texts, from the ids of their pieces. As a dict: piece -> its number.

    A piece is a pre-token in lower case where the text is Latin-1 and the tokenizer is known to split it so, else what stands between
    ASCII white space. Either is encoded once.
    """

    def __init__(self, path: str, most: int = 120_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.known_split = path.endswith("word_bpe_49k.json")
        self.new: list[str] = []
        self.starts, self.lens, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = n = len(self)
        return n

    def _learn(self) -> None:
        """Encode all new pieces. Those that are one pre-token each go as one text, whose word numbers tell them apart."""
        single = np.array([self.known_split and p == p.lower() and max(p, default="\uffff") < "\u0100" and PRE_TOKENS.fullmatch(p) is not None for p in self.new], bool)
        lens, starts = np.zeros(len(self.new), np.int64), np.zeros(len(self.new), np.int64)
        blocks, end = [self.flat], len(self.flat)

        def add(at: np.ndarray, counts: np.ndarray, ids: list[int]) -> None:
            nonlocal end
            lens[at], starts[at] = counts, end + np.cumsum(counts) - counts
            blocks.append(np.array(ids, np.uint32))
            end += len(ids)

        for some in np.array_split(np.flatnonzero(single), -(-int(single.sum()) // 16_384) or 1):
            e = self.tokenizer.encode(" ".join([self.new[j] for j in some]), add_special_tokens=False)
            add(some, np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)), e.ids)
        rest = np.flatnonzero(~single)
        found = [e.ids for e in self.tokenizer.encode_batch([self.new[j] for j in rest], add_special_tokens=False)]
        add(rest, np.array([len(x) for x in found], np.int64), [t for x in found for t in x])
        self.starts, self.lens, self.flat = np.concatenate((self.starts, starts)), np.concatenate((self.lens, lens)), np.concatenate(blocks)

    def _forget(self, n: int, end: int) -> None:
        for piece in self.new:
            del self[piece]
        self.starts, self.lens, self.flat = self.starts[:n], self.lens[:n], self.flat[:end]

    def pieces(self, text: str) -> list[str]:
        if self.known_split and "<|" not in text:
            try:
                text.encode("latin-1")
                return PRE_TOKENS.findall(text.lower())
            except UnicodeEncodeError:
                pass
        for space in "\t\n\x0b\x0c\r":
            text = text.replace(space, " ")
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        before, end, numbers = len(self), len(self.flat), []
        for text in texts:
            pieces = self.pieces(text)
            numbers.append(np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces)))
        if self.new:
            self._learn()
        out = []
        for at in numbers:
            lens = self.lens[at]
            ends = np.cumsum(lens)
            out.append(self.flat[np.repeat(self.starts[at] - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)])
        if before >= self.most:
            self._forget(before, end)
        self.new = []
        return out


@functools.cache
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One a Python worker: later tasks find the tokenizer loaded and most pieces known."""
    return ChunkTokenizer(path)


def _tokenize(path: str, limit: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = chunk_tokenizer(path)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, len(texts), 1024):
                rows: list[tuple] = []
                for i, ids in enumerate(tokenizer.encode(texts[at : at + 1024]), at):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), limit)):
                        part = ids[start : start + limit]
                        rows.append((i, piece, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if keep_ids else None))
                took, *cols = zip(*rows, strict=True)
                arrays = [doc_ids.take(pa.array(took)), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(cols[4], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        pa.default_memory_pool().release_unused()

    return run


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets of pieces that come in decreasing length."""
    n = len(lengths)
    whole, w = np.array(capacity, float), np.array(weights, float)
    left, number = np.empty((3, 64)), np.empty(64, np.int64)
    bins, offsets, used, made = np.empty(n, np.int64), np.empty(n, np.int64), 0, 0
    least = float(lengths[-1]) if n else 0.0
    for i, length in enumerate(lengths.tolist()):
        need = (float(length), 1.0, float(length) * length)
        open_left = left[:, :used]
        fits = np.flatnonzero((open_left[0] >= need[0]) & (open_left[1] >= need[1]) & (open_left[2] >= need[2]))
        if len(fits):
            rest = open_left[:, fits]
            if rule == "norm":
                score = sum(w[d] * ((rest[d] - need[d]) / whole[d]) ** 2 for d in range(3))
                best = fits[int(np.argmin(score))]
            else:
                score = sum(w[d] * (need[d] / whole[d]) * (rest[d] / whole[d]) for d in range(3))
                best = fits[int(np.argmax(score))]
        else:
            if used == left.shape[1]:
                left, number = np.concatenate((left, np.empty_like(left)), axis=1), np.concatenate((number, np.empty_like(number)))
            best = used
            left[:, best], number[best] = whole, made
            used, made = used + 1, made + 1
        bins[i], offsets[i] = number[best], int(whole[0] - left[0, best])
        left[:, best] -= need
        if left[0, best] < least or left[1, best] < 1 or left[2, best] < least * least:  # full: the last open one takes its place
            used -= 1
            left[:, best], number[best] = left[:, used], number[used]
    return bins, offsets


def unforced(lengths: np.ndarray, tokens: int, cost: float, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Best fit with a capacity for documents that costs no sequence."""
    free = best_fit(lengths, (float(tokens), float(tokens), cost), weights, rule)
    sequences = int(free[0].max()) + 1 if len(lengths) else 0
    if not sequences:
        return free
    bound = best_fit(lengths, (float(tokens), float(2 * -(-len(lengths) // sequences)), cost), weights, rule)
    return bound if int(bound[0].max()) < sequences else free


def _pack(tokens: int, docs: int | None, cost: float, weights: tuple[float, float, float], rule: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, (float(tokens), float(docs), cost), weights, rule) if docs else unforced(lengths, tokens, cost, weights, rule)
        pdf["sequence_id"] = (pdf["pack_group"].to_numpy(np.int64) << 32) + bins
        pdf["offset"] = offsets
        return pdf.drop(columns="pack_group")

    return run


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, max_tokens: int = 2048, max_docs: int | None = None,
    max_cost: float | None = None, weights: tuple[float, float, float] = (1.0, 0.1, 0.1), rule: str = "norm", end_id: int = 0,
    rows_per_group: int = 8192, least_sequences: int = 256, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    No sequence has more than max_tokens tokens, max_docs pieces (None: see above), or max_cost attention. max_cost must hold one piece of full
    length and is just that by default; no set of pieces that fits the tokens costs more, so there it bears on the choice of a sequence but never
    forbids one.
    """
    cost = float(max_cost or max_tokens**2)
    if cost < max_tokens**2:
        raise ValueError("max_cost must allow one piece of full length")
    text_batches(docs.sparkSession)
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = materialize(texts.mapInArrow(_tokenize(tokenizer or default_tokenizer(), max_tokens, end_id, keep_ids), schema), "pack-pieces")
    count, tokens = pieces.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    groups = max(1, min(-(-count // rows_per_group), tokens // (least_sequences * max_tokens)))
    key = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    packed = pieces.withColumn("pack_group", key).groupBy("pack_group")
    return packed.applyInPandas(_pack(max_tokens, max_docs, cost, weights, rule), schema + ", sequence_id long, offset long")
