from __future__ import annotations

import numpy as np

from wakeline.llm import language


def letters(i):
    return "".join(chr(0x4E00 + i * 7 + j) for j in range(6))


def test_every_language_is_learned(spark):
    rows = [(k * 300 + i, letters(i), f"l{i:03}") for i in range(300) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs, per_lang=2)
    assert len(model.langs) == 300
    got = language.predict_language(docs, model).join(docs, "doc_id").filter("lang = lang_pred").count()
    assert got > 0.97 * len(rows)


def test_gradients_summed_in_spark_are_those_of_the_driver(spark):
    rng, langs = np.random.default_rng(1), ["a", "b", "c", "d", "e", "f"]
    code, rows = language.codewords(6), []
    for i in range(60):
        at = np.sort(rng.choice(1 << language.BITS, 40, replace=False))
        rows.append((langs[i % 6], at.tolist(), rng.random(40).round(3).tolist()))
    x = np.zeros((60, 1 << language.BITS), np.float32)
    for i, (_, at, v) in enumerate(rows):
        x[i, at] = v
    w, b = language.train_bits(x, code[[i % 6 for i in range(60)]].astype(np.float32), steps=5)
    df = spark.createDataFrame(rows, "lang string, places array<int>, counts array<float>").repartition(3)
    ws, bs = language.train_bits_sparse(df, 60, langs, code, steps=5)
    assert np.allclose(w, ws, atol=1e-5) and np.allclose(b, bs, atol=1e-5)


def model_of(trust, near_code=None):
    code = np.array([[1.0, 1.0, -1.0], [-1.0, 1.0, 1.0], [1.0, -1.0, 1.0]]) if near_code is None else near_code
    return language.LanguageModel(("a", "b", "c"), code, np.zeros((1, 3)), np.zeros(3), np.array(trust, float))


def naive_decode(model, bits):
    import math

    losses = [sum(model.trust[i][j] * math.log(1 + math.exp(-model.code[i][j] * bits[j])) for j in range(3)) for i in range(3)]
    order = sorted(range(3), key=lambda i: (losses[i], i))
    weights = [math.exp(-x) for x in losses]
    return order[0], weights[order[0]] / sum(weights), losses[order[1]] - losses[order[0]]


def test_decoding_is_that_of_plain_loops():
    rng = np.random.default_rng(4)
    for _ in range(200):
        model, bits = model_of(rng.random((3, 3)) + 0.1), rng.normal(0, 2, 3)
        best, share, lead = language.decode(model, bits)
        want = naive_decode(model, bits)
        assert best == want[0] and abs(share - want[1]) < 1e-9 and abs(lead - want[2]) < 1e-9


def test_trust_changes_what_wins():
    bits = np.array([1.0, -1.2, 0.9])  # nearest to the third codeword
    assert language.decode(model_of(np.ones((3, 3))), bits)[0] == 2
    assert language.decode(model_of([[1, 0.1, 0.1], [1, 1, 1], [1, 3, 1]]), np.array([1.0, 0.2, -0.1]))[0] == 0
    weights = language.reliability(np.array([[10.0, 5.0], [10.0, 10.0]]), np.array([10.0, 10.0]))
    assert weights[0, 0] > weights[0, 1] and np.allclose(weights.mean(1), 1) and np.allclose(weights[1], 1)


def test_codewords_lie_apart():
    for n in (2, 3, 5, 12, 40):
        code = language.codewords(n)
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2) and set(np.unique(code)) == {-1.0, 1.0}


def test_a_very_common_language_and_rare_ones(spark):
    rows = [(i, "common words here " + letters(0), "xx") for i in range(9000)] + [(10_000 + i, letters(3 + i % 2), ["yy", "zz"][i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_language(docs, per_lang=50)
    assert model.langs == ("xx", "yy", "zz")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
