"""Divergences against plain Python integers, with spills, many sources, odd input."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wakeline.llm.divergence import Emitter, divergences, excess, shares

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, top=200):
    count, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
        count[lang, source] += found
        df[lang].update(found.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (count[lang, s][t] + 1) // (n[s] + len(kept)) for t in kept} for s in sources}
        whole = {t: 1 + 10**9 * (sum(count[lang, s][t] for s in sources) + 1) // (sum(n.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], whole[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > whole[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(ranked, 1)]
    return sorted(out)


def made(rows, frame, **how):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergences(frame, **how).collect())


@pytest.mark.parametrize("entries", [3, 10**6])
def test_against_plain_integers(spark, entries):
    rng = random.Random(entries)
    word = lambda: rng.choice(["alpha", "Beta", "beta", "ÉCOLE", "école", "ſharp", "x1y", "漢字", "w" + chr(97 + rng.randrange(26))])
    rows = [(rng.choice([None, "", "12 34"]) if rng.random() < 0.1 else " ,".join(word() for _ in range(rng.randrange(1, 40))), rng.choice(["en", "en", "de", None]), f"s{rng.randrange(6)}") for _ in range(150)]
    rows += [("only here", "xx", "a"), (None, "xx", "b"), (None, "yy", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOC).repartition(4)
    assert made(rows, frame, entries=entries, bucket_terms=4) == brute(rows)
    assert made(rows, frame, entries=entries, top=3) == brute(rows, top=3)


def test_sparse_sources(spark):
    """Far more sources than a term has: zeros are multiplied, not visited."""
    rng = random.Random(5)
    rows = [(" ".join(f"t{chr(97 + (s * 7 + rng.randrange(9)) % 26)}" for _ in range(5)), "en", f"s{s}") for s in range(40) for _ in range(3)]
    assert made(rows, spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOC), bucket_terms=2) == brute(rows)


def test_large_counts_are_exact():
    rng = random.Random(1)
    for high in (10**6, 10**13, 10**17):
        counts, total = [rng.randrange(high) for _ in range(200)], [high + rng.randrange(1000) for _ in range(200)]
        assert shares(np.array(counts), np.array(total)).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(counts, total, strict=True)]
    p, q = np.array([10**9 + 1, 1, 5]), np.array([1, 10**9 + 1, 5])
    assert excess(p, q).tolist() == [10**18, 10**18 // (10**9 + 1), 0]
    few = Emitter("en", ["a", "b"], [0, 0], 0, 5)
    few.add([])
    assert [r[4] for r in few.rows(True)] == [0, 0]


def test_odd(odd_docs, no_docs):
    rows = [(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()]
    assert made(rows, odd_docs) == brute(rows)
    assert divergences(no_docs).count() == 0
