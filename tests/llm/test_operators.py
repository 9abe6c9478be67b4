"""Each operator against a brute-force version, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wakeline.llm import exact_dedup as ed
from wakeline.llm import jaccard as jc
from wakeline.llm import substring_dedup as sd
from wakeline.llm.chat_format import format_chats, read_back
from wakeline.llm.components import connected_components
from wakeline.llm.language import UNDETERMINED, codewords, fit_language, predict_language
from wakeline.llm.license_rules import BASE_PHRASES, rules
from wakeline.llm.license_scan import Scanner, scan_licenses
from wakeline.llm.mixing import mix, targets
from wakeline.llm.packing import best_fit, default_tokenizer, pack, unforced
from wakeline.llm.quality import fit_quality, score_quality


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- 1 mixing
def water_fill(sizes, cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_targets(spark):
    sizes = {"b": 10, "a": 1000, None: 5, "Z": 400, "é": 1, "c": 3000}
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = water_fill(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_mix(docs):
    rows = mix(docs).collect()
    text = {r["doc_id"]: r for r in docs.collect()}
    size = {i: len(words(r["text"])) for i, r in text.items()}
    by_source = Counter()
    for i, r in text.items():
        by_source[r["source"]] += size[i]
    want, taken, largest = water_fill(by_source), Counter(), Counter()
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[text[r["doc_id"]]["source"]] += r["taken"]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
    assert len(rows) == len(text)
    for s, t in want.items():
        assert abs(taken[s] - t) < 0.06 * t + 30
    assert sorted((r["doc_id"], r["copies"]) for r in mix(docs.repartition(5)).collect()) == sorted((r["doc_id"], r["copies"]) for r in rows)


def test_mix_odd(odd_docs, no_docs):
    rows = mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert mix(no_docs).count() == 0


def test_long_documents_leave_their_rest_to_short_ones(spark):
    """A source with one very long document and 200 short ones: its target is met to less than the smallest document, in one bucket or many."""
    rng = random.Random(4)
    rows = [(0, "w " * 30_000, "a")] + [(i, "w " * rng.randrange(1, 51), "a") for i in range(1, 201)] + [(1000 + i, "w " * 60, "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights, per_bucket in (((1, 2), 8192), ((1, 3), 40), ((1, 2), 40), ((1, 6), 64)):
        got = mix(docs, weights=weights, rows_per_bucket=per_bucket).collect()
        taken, target = Counter(), {r["source"]: r["target"] for r in got}
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        most = 3 * sum(len(t.split()) for i, t, s in rows if s == "a" and i)  # all that the short ones can give
        for s, least in (("a", 1), ("b", 60)):
            goal = most if s == "a" and target[s] > most else target[s]
            assert abs(taken[s] - goal) <= max(least, 0.0005 * target[s]) + 1e-6, (weights, per_bucket, s, taken, target)


def test_rates_solve_the_dual(spark):
    """Against bisection on each source's own multiplier: same rates."""
    rng = random.Random(8)
    rows = [(s * 1000 + i, "w " * rng.randrange(1, 200), f"s{s}") for s in range(3) for i in range(150)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("s0", "s1", "s2"):
        of = [r for r in got if r["source"] == s]
        low, high = -1.0, 1.0
        for _ in range(200):
            lam = (low + high) / 2
            low, high = (lam, high) if sum(r["size"] * min(3.0, math.exp(min(700, lam * r["size"]))) for r in of) < of[0]["target"] else (low, lam)
        assert all(abs(r["rate"] - min(3.0, math.exp(min(700, lam * r["size"])))) < 1e-6 for r in of)


def test_an_unsolved_dual_fails(docs):
    from wakeline.llm import mixing

    light = docs.select("source", mixing.word_count(F.col("text")).alias("size"))
    hist = light.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"))
    goals = targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).cast("long").alias("source_size")))
    with pytest.raises(RuntimeError, match="not solved"):
        mixing.dual(hist.filter("size > 0"), goals, steps=1)


# ---------------------------------------------------------------- 2 Jaccard
def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, n=60):
    rng, base = random.Random(seed), []
    for i in range(n):
        if base and rng.random() < 0.7:
            w = list(rng.choice(base)[1].split(" "))
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(50)}"
            if rng.random() < 0.3:
                w = w[: max(1, int(len(w) * rng.uniform(0.6, 1)))]
            base.append((i, " ".join(w)))
        else:
            base.append((i, " ".join(f"v{rng.randrange(300)}" for _ in range(rng.choice([1, 3, 5, 8, 30, 60, 120])))))
    return base


@pytest.mark.parametrize(("seed", "region"), [(1, 1024), (2, 4), (3, 2)])
def test_jaccard(spark, seed, region):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jc.jaccard_components(df, region_rows=region, frequent_above=3, block_shingles=50).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("seed", range(8))
def test_region_is_exact(seed):
    rng = np.random.default_rng(seed)
    sets = [np.unique(rng.integers(0, 60, rng.integers(3, 60)).astype(np.uint64))]
    for _ in range(40):
        s = sets[rng.integers(len(sets))].copy()
        sets.append(np.unique(np.where(rng.random(len(s)) < 0.08, rng.integers(0, 60, len(s)).astype(np.uint64), s)))
    want = {frozenset((i, j)) for i, j in combinations(range(len(sets)), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}

    def groups(pairs):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(sets))]

    assert groups(jc.Region(np.arange(len(sets)), sets, 75).links()) == groups(map(tuple, want))


def test_jaccard_odd(odd_docs, no_docs):
    rows = jc.jaccard_components(odd_docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert by_id[2]["component_id"] == 1 and by_id[7]["component_id"] == 6 and by_id[3]["component_id"] == 3 and by_id[3]["n_shingles"] == 0 and by_id[8]["n_shingles"] == 1
    assert by_id[None]["component_id"] is None
    assert jc.jaccard_components(no_docs).count() == 0


def test_components(spark):
    links = [(i + 1, i) for i in range(60)] + [(100, 101), (101, 102), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def test_ids_with_several_texts(spark):
    """Every text of an id links: rows are documents, named by their ids."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, "c c c c c c"), (4, a), (5, None), (5, "d d d d d d")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jc.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(1, 36, 1), (1, 36, 1), (2, 37, 1), (3, 37, 1), (4, 1 + 1 - 1, 4), (4, 36, 1), (5, 0, 5), (5, 1, 5)])


# ---------------------------------------------------------------- 3 packing
def test_pack(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    want = {}
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[r["doc_id"], k] = (s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))
    rows = pack(docs).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
    assert len(bins) <= 1.02 * sum(n for _, n, _ in want.values()) / 2048 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.sort(np.random.default_rng(0).integers(1, 101, 500))[::-1]
    bins, offsets = best_fit(lengths, (100.0, 4.0, 10_000.0), (1.0, 0.2, 0.2), rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own.astype(float) ** 2).sum() <= 10_000
        assert sorted(offsets[bins == b]) == sorted(np.cumsum(own) - own)


def test_pack_odd(odd_docs, no_docs):
    rows = pack(odd_docs).collect()
    assert [r["length"] for r in rows if r["doc_id"] in (3, 4, 5)] == [1, 1, 1]
    assert sum(r["doc_id"] == 8 for r in rows) == 2
    assert pack(no_docs).count() == 0
    assert all(len(r["ids"]) == r["length"] for r in pack(odd_docs, keep_ids=True).collect())


@pytest.mark.parametrize(("tokens", "n"), [(1, 9000), (2, 9000), (5, 9000), (10, 12_000)])
def test_short_texts_fill_sequences(spark, tokens, n):
    """No capacity but that for tokens costs a sequence."""
    docs = spark.range(n).select(F.col("id").alias("doc_id"), (F.lit(None).cast("string") if tokens == 1 else F.lit("the " * (tokens - 1))).alias("text"))
    rows = pack(docs).select("sequence_id", "length").collect()
    total = sum(r["length"] for r in rows)
    assert total == n * tokens
    assert len({r["sequence_id"] for r in rows}) <= 1 + 1.01 * total / 2048


def test_the_capacity_for_documents_is_chosen_per_group():
    rng = np.random.default_rng(6)
    lengths = np.sort(np.concatenate((rng.integers(1, 40, 3000), rng.integers(500, 2048, 300))))[::-1]
    free = best_fit(lengths, (2048.0, 2048.0, 2048.0**2), (1.0, 0.1, 0.1))[0]
    bins, _ = unforced(lengths, 2048, 2048.0**2, (1.0, 0.1, 0.1), "norm")
    assert bins.max() <= free.max()
    assert max(Counter(bins.tolist()).values()) <= max(Counter(free.tolist()).values())


# ---------------------------------------------------------------- 4 quality, 9 language
def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    rows = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.93
    assert np.mean([r["predicted"] for r in rows if r["quality"] == 1]) > 0.93


def test_quality_odd(docs, labels, odd_docs, no_docs):
    model = fit_quality(docs, labels)
    rows = score_quality(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert score_quality(no_docs, model).count() == 0
    assert {r["score"] for r in score_quality(odd_docs, fit_quality(docs, labels.filter("quality = 1"))).collect()} == {1.0}
    assert {r["predicted"] for r in score_quality(odd_docs, fit_quality(no_docs, labels.limit(0))).collect()} == {1}


def test_language(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rows = predict_language(docs, fit_language(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


def test_language_odd(docs, odd_docs, no_docs):
    got = defaultdict(set)
    for r in predict_language(odd_docs, fit_language(docs)).collect():
        got[r["doc_id"]].add(r["lang_pred"])
    assert got[3] == got[4] == got[5] == got[11] == {UNDETERMINED}
    assert UNDETERMINED not in got[10]
    assert predict_language(no_docs, fit_language(docs)).count() == 0
    assert {r["lang_pred"] for r in predict_language(docs, fit_language(no_docs)).collect()} == {UNDETERMINED}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = codewords(n)
    assert code.shape[0] == n
    assert min(int((code[a] != code[b]).sum()) for a, b in combinations(range(n), 2)) >= (1 if n == 2 else 2)


# ---------------------------------------------------------------- 5 exact dedup
def test_rice_code():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 5000):
        v = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) + np.uint64(1 << 62)
        assert (ed.rice_decode(ed.rice_encode(v, 1 << 62, 60), 1 << 62) == v).all()


def test_exact_dedup_odd(odd_docs, no_docs):
    rows = ed.exact_dedup(odd_docs).collect()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows}
    assert len(rows) == odd_docs.count()
    assert got[2] == (2, 3, True) and got[1] == (2, 3, False) and got[None] == (2, 3, False)
    assert got[5] == (5, 3, True) and got[3] == got[4] == (5, 3, False)
    assert got[8] == (8, 2, True)
    assert next(r["text_sha256"] for r in rows if r["doc_id"] == 9) == hashlib.sha256(b"twowords").hexdigest()
    assert ed.exact_dedup(no_docs).count() == 0


# ---------------------------------------------------------------- 6 chats
def test_chats_odd(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<|b"), (2, 0, "user", "hi"), (2, 1, "assistant", "a\\<|b"), (3, 0, "user", "hi"), (3, 1, "assistant", "c"), (4, None, None, None), (5, 1, "as\nk\\", "</s>\n"), (5, 0, "assistant", ""), (5, 1, "as\nk\\", "</s>\n"), (None, 0, "user", "<<SYS>>")]
    segments, leaves = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r["conv_id"]: r for r in leaves.join(read_back(segments), "digest").collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (out[c]["n_turns"], out[c]["turns_sha256"], out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert sum(len(s["leaves"]) for s in segments.collect()) == 5  # equal conversations are written once
    for s in segments.collect():
        assert len(s["token_ids"]) == len(s["position_ids"]) == len(s["loss_mask"])
        for n in s["nodes"]:
            assert s["position_ids"][n["start"]] == sum(a["end"] - a["start"] for a in n["attends"]) == n["position"]
    empty, none = format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert empty.count() == none.count() == 0


def test_shared_turns_are_written_once(spark):
    rows = [(c, 0, "user", "a long shared beginning " * 20) for c in range(50)] + [(c, 1, "assistant", str(c)) for c in range(50)]
    segments, _ = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sum(n["parent"] == -1 for s in segments.collect() for n in s["nodes"]) <= 3  # once a segment


# ---------------------------------------------------------------- 7 licenses
def brute_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, label) for p, label in BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found}))


def test_licenses(spark, docs):
    extra = [(10_000, "CC-BY cc by\tcc by-sa; ALL rights\nreserved"), (10_001, "éall rights reserved, GENERAL public License"), (10_002, None), (10_003, "cc by " * 3000)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] for r in both.collect()}
    for r in scan_licenses(both).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_places(text[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_license_rules():
    scanner = Scanner(BASE_PHRASES, rules())
    labels = lambda t: [d[2] for d in scanner.scan(t)[5]]
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache"]
    assert labels("Released under the terms of the GNU Lesser General Public License v3 or later") == ["lgpl"]  # the part "General Public License v3" lies within
    assert labels("SPDX-License-Identifier: MIT License") == ["mit"]
    assert labels("nothing here") == []


def test_licenses_odd(odd_docs, no_docs):
    assert scan_licenses(odd_docs).count() == odd_docs.count()
    assert scan_licenses(no_docs).count() == 0


# ---------------------------------------------------------------- 10 substrings
def brute_removed(rows, window):
    seen = Counter(tuple(w[i : i + window]) for _, w in rows for i in range(len(w) - window + 1))
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "crowded"), [(1, 1000), (2, 2), (3, 0)])
def test_substrings(spark, seed, crowded):
    rng = random.Random(seed)
    passages = [[f"p{j}.{k}" for k in range(rng.randrange(20, 80))] for j in range(6)]
    rows = []
    for i in range(50):
        w = []
        for _ in range(rng.randrange(0, 6)):
            kind = rng.random()
            w += rng.choice(passages)[rng.randrange(0, 10) :] if kind < 0.4 else ["to"] * rng.randrange(1, 60) if kind < 0.5 else ["x", "y"] * rng.randrange(1, 30) if kind < 0.6 else [f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 60))]
        rows.append((i, w))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.remove_repeats(df, window=12, gram=5, crowded=crowded, shard_runs=40).collect()]
    assert sorted(got, key=repr) == brute_removed(rows, 12)


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    text = np.concatenate([np.append(rng.integers(1, 4, 30), 0) for _ in range(20)])
    index = sd.FMIndex(text, 12)
    ends = np.array([e for e in range(12, len(text)) if (text[e - 12 : e] > 0).all()])
    seen = Counter(tuple(text[e - k : e]) for k in range(1, 13) for e in range(k, len(text) + 1))
    want = [max([k for k in range(1, 13) if seen[tuple(text[e - k : e])] > 1], default=0) for e in ends]
    assert index.matching(text, ends, 12).tolist() == want


@pytest.mark.parametrize(("seed", "rule"), [(0, "norm"), (1, "dot"), (2, "norm")])
def test_every_piece_goes_where_a_naive_search_would_put_it(seed, rule):
    rng = np.random.default_rng(seed)
    lengths = np.sort(np.where(rng.random(400) < 0.5, rng.integers(1, 8, 400), rng.integers(1, 101, 400)))[::-1]
    capacity, weights = (100.0, 6.0, 4000.0 if rule == "norm" else 10_000.0), (1.0, 0.5, 0.3)
    lengths = lengths[lengths**2 <= capacity[2]]
    bins, offsets = best_fit(lengths, capacity, weights, rule)
    left = {}
    bound = [0, 0, 0]
    for length, b, offset in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        need = (length, 1, length * length)
        scores = {}
        for i, rest in left.items():
            short = [rest[d] < need[d] for d in range(3)]
            if not any(short):
                scores[i] = sum(weights[d] * (((rest[d] - need[d]) / capacity[d]) ** 2 if rule == "norm" else -need[d] * rest[d] / capacity[d] ** 2) for d in range(3))
            elif sum(short) == 1:
                bound[short.index(True)] += 1
        if scores:
            assert scores[b] <= min(scores.values()) + 1e-12
        else:
            assert b not in left
        rest = left.setdefault(b, list(capacity))
        assert offset == capacity[0] - rest[0]
        for d in range(3):
            rest[d] -= need[d]
    assert bound[0] and bound[1] and (bound[2] or rule == "dot")  # every capacity has forbidden something that the others allowed


def test_substrings_odd(odd_docs, no_docs):
    rows = [(r["doc_id"], words(r["text"])) for r in odd_docs.collect()]
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.remove_repeats(odd_docs).collect()]
    assert sorted(got, key=repr) == brute_removed(rows, 35)
    assert sd.remove_repeats(no_docs).count() == 0
