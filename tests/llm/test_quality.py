"""The compression classifier against a plain version of its difference, prior, clip and curve."""

from __future__ import annotations

import math
import zlib

import numpy as np
import zstandard

from tests.conftest import SF
from wakeline.llm.quality import BLOCK, CLEAR, PRIOR_BYTES, fit_quality, logistic, score_quality


def plain_difference(text, good, bad):
    raw, sizes = (text or "").encode(), []
    for data in (good, bad):
        total = 0
        for at in range(0, len(raw), BLOCK):
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(packer.compress(raw[at : at + BLOCK]))
        sizes.append(total)
    share = (sizes[1] - sizes[0] + PRIOR_BYTES) / (len(raw) + 4 * PRIOR_BYTES)
    return max(-CLEAR, min(CLEAR, share))


def test_scores_against_the_plain_version(spark, odd_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(docs, labels)
    for table in (docs, odd_docs):
        text = {}
        for r in table.select("doc_id", "text").collect():
            text.setdefault(r["doc_id"], r["text"])
        for r in score_quality(table, model).collect():
            want = plain_difference(text[r["doc_id"]], model.good, model.bad)
            score = 1 / (1 + math.exp(-(model.slope * want + model.offset)))
            assert abs(r["difference"] - want) < 1e-12 and abs(r["score"] - score) < 1e-12
            assert r["predicted"] == int(r["score"] >= 0.7)
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    empty = next(r for r in score_quality(odd_docs, model).collect() if r["doc_id"] == 3)
    assert abs(empty["difference"] - PRIOR_BYTES / (4 * PRIOR_BYTES)) < 1e-12  # the prior alone


def test_the_curve_is_the_weighted_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.1, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(20 * x - 0.5)))).astype(float)
    weight = np.where(y == 1, 1.7, 0.4)
    slope, offset = logistic(x, y, weight)

    def loss(a, b):
        z = a * x + b
        return np.sum(weight * (np.logaddexp(0, z) - y * z))

    best = loss(slope, offset)
    assert slope > 0
    for da, db in ((0.1, 0), (-0.1, 0), (0, 0.02), (0, -0.02)):
        assert loss(slope + da, offset + db) > best - 1e-6
    assert logistic(-x, y, weight)[0] == 0.0  # a curve never falls: a larger difference never makes a text worse
