"""License scan with ordered signature rules (operator 7).

Each whole text is brought to normal form (words in lower case, single spaces). One pass of an Aho-Corasick automaton over it finds the
base phrases and the keywords of all rules; a rule's regular expression runs only where its keyword occurs. Overlapping detections
are resolved by order: from the highest priority, then the longest, then the first rule, a detection is dropped when its interval lies
within that of one already taken. The base phrases are reported in any case, every occurrence of them.

Defined results: null texts count as empty; without any label base_labels and labels are empty strings and the score is 0; first_word and last_word
are null without a base phrase; repeated rows are scanned once a row; very long texts are scanned whole; of detections that tie in priority and
length the rule that stands first is taken; an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches
from .license_rules import BASE_PHRASES, Rule, rules

#: Bytes that are no part of a word become spaces, A to Z lower case; bytes from 0x80 on belong to words.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


class Scanner:
    def __init__(self, phrases: dict[str, str], signatures: list[Rule]):
        import ahocorasick

        self.rules = [(r, re.compile(r.pattern, re.DOTALL)) for r in signatures]
        self.phrases = phrases
        gates: dict[str, list[int]] = {}
        for i, r in enumerate(signatures):
            gates.setdefault(f" {r.keyword} ", []).append(i)
        self.automaton = ahocorasick.Automaton()
        for key in {f" {p} " for p in phrases} | set(gates):
            self.automaton.add_word(key, (key, tuple(gates.get(key, ()))))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, int, int | None, int | None, set[str], list[tuple[int, int, str, float]]]:
        """Words, base places, first and last of them, base labels, and surviving detections as (start, end, label, weight)."""
        words = text.encode("utf-8", "surrogatepass").translate(NORMAL).split()
        normal = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        base: list[tuple[int, str]] = []
        awake: set[int] = set()
        for end, (key, gate) in self.automaton.iter(normal):
            awake.update(gate)
            if key[1:-1] in self.phrases:
                base.append((end - len(key) + 1, self.phrases[key[1:-1]]))
        found = []
        for i in sorted(awake):
            rule, regex = self.rules[i]
            found += [(-rule.priority, m.start() - m.end(), i, m.start(), m.end()) for m in regex.finditer(normal)]
        taken: list[tuple[int, int, str, float]] = []
        starts: list[int] = []  # of the widest intervals taken so far; both starts and ends rise
        ends: list[int] = []
        for _, _, i, start, end in sorted(found):
            at = bisect_right(starts, start)
            if at and ends[at - 1] >= end:
                continue
            taken.append((start, end, self.rules[i][0].label, self.rules[i][0].weight))
            low, high = bisect_left(starts, start), bisect_right(ends, end)
            starts[low:high], ends[low:high] = [start], [end]
        first = last = None
        if base or taken:
            spaces = np.flatnonzero(np.fromiter((c == " " for c in normal), bool, len(normal)))
            if base:
                first, last = (int(np.searchsorted(spaces, x)) for x in (min(base)[0], max(base)[0]))
            taken = [(int(np.searchsorted(spaces, s)) - 1, int(np.searchsorted(spaces, e)), label, w) for s, e, label, w in taken]
        return len(words), len(base), first, last, {label for _, label in base}, sorted(taken)


def _scan(phrases: dict[str, str], signatures: list[Rule]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, signatures)
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("weight", pa.float64())]))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, places, first, last, base, taken = scanner.scan(text)
                miss = 1.0
                for label, weight in sorted({(d[2], d[3]) for d in taken} | {(label, 0.5) for label in base}):
                    miss *= 1 - weight
                detections = [{"start": s, "end": e, "label": label, "weight": w} for s, e, label, w in taken]
                rows.append((n, places, first, last, ",".join(sorted(base)), ",".join(sorted(base | {d[2] for d in taken})), 1 - miss, detections))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, signatures: list[Rule] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (word spans, end exclusive)."""
    text_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start: long, end: long, label: string, weight: double>>"
    return rows.mapInArrow(_scan(phrases or BASE_PHRASES, signatures or rules()), schema)
