"""Every stage of the pipeline against a brute-force version of its decision, and the whole on odd input."""

from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from tests.conftest import SF
from tests.llm.test_operators import brute_components
from wakeline.llm.mixing import mix
from wakeline.llm.quality import fit_quality, score_quality


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage, and what comes out of the last."""
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(spark, stages):
    scores = score_quality(stages[0], fit_quality(stages[0], spark.read.parquet(f"{SF}/labels.parquet")))
    good = {r["doc_id"] for r in scores.collect() if r["predicted"] == 1}
    assert rows(stages[1]) == Counter({r: n for r, n in rows(stages[0]).items() if r[0] in good})


def test_exact(stages):
    best = {}
    for r in stages[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")
        best[key] = min(best.get(key, (1, 1)), (-len(r["text"] or ""), r["doc_id"]))
    assert {r["doc_id"] for r in stages[2].collect()} == {i for _, i in best.values()}
    assert stages[2].count() == len(best)


def test_near(stages):
    found = brute_components([(r["doc_id"], r["text"]) for r in stages[2].collect()])
    assert sorted(r["doc_id"] for r in stages[3].collect()) == sorted(i for i, (_, c) in found.items() if i == c)


def test_mix(stages):
    copies = {r["doc_id"]: r["copies"] for r in mix(stages[3]).collect()}
    got = Counter(r["doc_id"] for r in stages[4].collect())
    assert got == Counter({i: n for i, n in copies.items() if n})


def test_pack(stages):
    pieces = stages[5].collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == Counter(r["doc_id"] for r in stages[4].collect())
    used = Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048


def test_odd(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        df = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in cp.STAGES[:-1]:
            before = df.count()
            df = stage(spark, df, SF)
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert df.count() <= 3 * before
        assert cp.STAGES[-1][1](spark, df, SF).count() >= df.count()
