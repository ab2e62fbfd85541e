"""Transforms, wavelet features and encoder layers against NumPy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.functions.fourier import fft
from helixlake.operators import attention, wavelets, linalg
from helixlake.plans import kernels


@pytest.mark.parametrize("n", [1, 2, 8, 64, 1024])
def test_fft_equals_the_defining_sum(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k, rng.normal(size=n).tolist(), rng.normal(size=n).tolist()) for k in range(3)]
    df = spark.createDataFrame(rows, "k int, re array<double>, im array<double>")
    turn = np.exp(-2j * np.pi * np.outer(np.arange(n), np.arange(n)) / n)
    for r in df.select("k", fft(F.col("re"), F.col("im"), n).alias("z"), fft(F.col("re"), F.col("im"), n, inverse=True).alias("back")).collect():
        x = np.array(rows[r.k][1]) + 1j * np.array(rows[r.k][2])
        assert np.allclose([c.re + 1j * c.im for c in r.z], turn @ x, atol=1e-9)
        assert np.allclose([c.re + 1j * c.im for c in r.back], turn.conj() @ x / n, atol=1e-9)


def test_fft_of_short_and_long_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([],), ([1.0] * 9,), (None,)], "re array<double>")
    found = [[round(c.re, 9) for c in r.z] for r in df.select(fft(F.col("re"), None, 4).alias("z")).collect()]
    assert found == [[3.0, 1.0, -1.0, 1.0], [0.0] * 4, [4.0, 0.0, 0.0, 0.0], [0.0] * 4]
    with pytest.raises(ValueError, match="power of two"):
        fft(F.col("re"), None, 6)


@pytest.mark.parametrize("block", [32, 4096])
def test_wavelet_features_of_blocks(spark, block):
    rng = random.Random(block)
    scales = (0.5, 2.0, 6.0)
    seqs = ["".join(rng.choice("ACGTacgtN ") for _ in range(n)) for n in (1, 2, 5, 31, 32, 33, 64, 100, 257)] + ["é\U0001f600A" * 40]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(seqs)] + [(99, ""), (98, None)], "k int, seq string")
    found = {}
    for r in wavelets.wavelet_features(rows, ["k"], scales, block=block).collect():
        found.setdefault(r.k, {})[r.start] = np.array(r.features).T
        assert r.n == len(seqs[r.k]) and len(r.features[0]) == r.size
    assert sorted(found) == list(range(len(seqs)))
    for k, seq in enumerate(seqs):
        got = np.concatenate([found[k][a] for a in sorted(found[k])])
        assert np.allclose(got, kernels.features(seq, scales), atol=1e-9)


def test_wavelets_leave_a_task_in_bounded_pieces(spark):
    """However few values a task may hold, features are the same, and their sums are those of block_sums."""
    scales, seqs = (0.5, 2.0), ["ACGTTGCAAC" * k + "A" * (k % 3) for k in range(1, 30)]
    blocks = wavelets.signal_blocks(spark.createDataFrame(list(enumerate(seqs)), "k int, seq string"), ["k"], scales, block=64).coalesce(1)
    sizes = spark.createDataFrame([(c,) for c in (1, 300, 1 << 19)], "cells int").collect()
    made = [{(r.k, r.start): r.features for r in wavelets.transformed(blocks, scales, s.cells).collect()} for s in sizes]
    assert made[0] == made[1] == made[2] and len(made[0]) == blocks.count()
    for r in wavelets.block_sums(blocks, scales, 300).collect():
        parts = np.array(made[0][r.k, r.start]).reshape(2, 2, -1)
        assert np.allclose(r.sums, np.concatenate([parts.sum(-1), (parts**2).sum((1, 2))[:, None]], axis=1))


def matrix(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i int, j int, v double")


def test_encoder_layer_equals_the_kernel(spark):
    width, heads, hidden = 8, 2, 12
    rng = np.random.default_rng(3)
    p = kernels.initial(width, 1, hidden, 2, 5)
    for name in ("b1", "b2", "g1", "e1", "g2", "e2"):
        p[f"0.{name}"] = p[f"0.{name}"] + rng.normal(size=p[f"0.{name}"].shape) / 5
    inputs = {w: rng.normal(size=(n, 4)) for w, n in (("a", 6), ("b", 1), ("c", 3))}
    rows, expected = [], {}
    for w, x in inputs.items():
        _, (layer, h) = kernels.forward(p, x, heads, 6)
        rows += [(w, t, row.tolist()) for t, row in enumerate(layer[0])]
        expected |= {(w, t): row for t, row in enumerate(h)}
    df = spark.createDataFrame(rows, "w string, t int, x array<double>")
    weights = {n: matrix(spark, p[f"0.{n}"]) for n in ("wq", "wk", "wv", "wo", "w1", "w2")}
    vectors = {n: F.array(*[F.lit(float(v)) for v in p[f"0.{n}"].ravel()]) for n in ("b1", "b2", "g1", "e1", "g2", "e2")}
    found = {(r.w, r.t): r.x for r in attention.encoder_layer(df, weights, vectors, ["w"], heads, width).collect()}
    assert sorted(found) == sorted(expected)
    assert all(np.allclose(found[k], expected[k], atol=1e-9) for k in found)
    with pytest.raises(ValueError, match="divide"):
        attention.multi_head_attention(df, *list(weights.values())[:4], ["w"], 3, width)


def test_products_stand_where_the_row_is(spark):
    """Rows times matrices in Arrow tasks, and the attention made once in a layer."""
    rng = np.random.default_rng(1)
    x, a, b = rng.normal(size=(7, 4)), rng.normal(size=(4, 3)), rng.normal(size=(4, 2))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "t int, x array<double>")
    found = attention.multiplied(rows, "x", "y", attention.matrix_of(matrix(spark, a)), b).orderBy("t").collect()
    assert np.allclose([r.y for r in found], np.concatenate([x @ a, x @ b], axis=1))
    assert attention.multiplied(rows.where("t < 0"), "x", "y", a).count() == 0
    weights = {n: matrix(spark, rng.normal(size=(4, 4))) for n in ("wq", "wk", "wv", "wo", "w1", "w2")}
    ones = F.array(*[F.lit(1.0)] * 4)
    layer = attention.encoder_layer(rows.withColumn("w", F.lit(0)), weights, dict.fromkeys(("b1", "b2", "g1", "e1", "g2", "e2"), ones), ["w"], 2, 4)
    assert layer._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 5  # q, k and v for the queries and for what they see


def test_convolution_of_texts_without_a_shuffle(spark):
    taps = kernels.wavelet(2.0, 21)
    texts = ["", None, "A", "GATTACA", "ACGTTGCAACNé\U0001f600" * 5, "T" * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").coalesce(1)
    for cells in (1, 50, 1 << 18):
        made = linalg.convolve_texts(rows, ["k"], "s", taps, cells)
        assert "Exchange hash" not in made._jdf.queryExecution().executedPlan().toString()
        found = {(r.k, r.pos): complex(r.re, r.im) for r in made.collect()}
        assert len(found) == sum(len(t or "") for t in texts)
        for k, t in enumerate(texts):
            if t:
                assert np.allclose([found[k, p] for p in range(len(t))], np.convolve(kernels.base_signal([t])[0], taps)[10 : 10 + len(t)])
