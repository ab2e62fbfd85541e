"""Kernels against numpy, finite differences and relations; the whole job on a made genome."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from helixlake.functions import numeric, sequence
from helixlake.operators import linalg
from helixlake.plans import annotate, kernels
from helixlake.sources.config import Config
from helixlake.sources.model import load_model

SMALL = Config(d_model=8, num_encoder_layers=2, num_heads=2, d_ff=6, cwt_scales=(2.0, 3.0), window_size=30, window_overlap=6, dropout_rate=0.0)


def test_features_are_the_direct_convolution(spark):
    rng = random.Random(0)
    seq = "".join(rng.choice("ACGTNacgt") for _ in range(57))
    x = kernels.features(seq, (2.0, 7.5))
    for k, scale in enumerate((2.0, 7.5)):
        length = kernels.wavelet_samples(scale, len(seq))
        full = np.convolve(kernels._SIGNAL[np.frombuffer(seq.encode(), np.uint8)], kernels.wavelet(scale, length))
        part = full[length // 2 : length // 2 + len(seq)]
        assert np.allclose(x[:, 2 * k] + 1j * x[:, 2 * k + 1], part)
    # and the relational one
    rows = sequence.signal(spark.createDataFrame([(seq, len(seq))], "s string, n int"), "s", "n")
    re, im = numeric.morlet(F.col("k"), F.lit(2.0), F.lit(21))
    kernel = spark.range(21).select(F.col("id").cast("int").alias("k")).select("k", re.alias("kre"), im.alias("kim"))
    found = linalg.convolve(rows, kernel, 21, []).orderBy("pos").collect()
    assert np.allclose([[r.re, r.im] for r in found], x[:, :2])


def test_unknown_bases_are_zero():
    assert not kernels.features("NNNNN nnné中", (2.0,)).any()


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(1)
    p = kernels.initial(8, 2, 6, 2, 4)
    for name in p:
        p[name] = p[name] + rng.normal(size=p[name].shape) * 0.1
    x, y = kernels.features("ACGTTGCAACGTAC", (2.0, 3.0)), rng.integers(-1, 4, 14)

    def loss():
        return kernels.loss_and_gradient(kernels.forward(p, x, 2, 30)[0], y)[0]

    logits, caches = kernels.forward(p, x, 2, 30)
    grads = kernels.backward(p, x, caches, kernels.loss_and_gradient(logits, y)[1], 2)
    assert set(grads) == set(p)
    for name in p:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            kept, h = p[name][at], 1e-5
            p[name][at] = kept + h
            up = loss()
            p[name][at] = kept - h
            down = loss()
            p[name][at] = kept
            assert abs((up - down) / (2 * h) - grads[name][at]) < 1e-6, name


def test_softmax_of_large_values():
    assert np.allclose(kernels.softmax(np.array([[1e3, -1e3, 1e3]])), [[0.5, 0, 0.5]])


def test_dropout_limits():
    p = kernels.initial(8, 1, 6, 2, 4)
    x = kernels.features("ACGTTGCAACGTAC", (2.0, 3.0))
    plain = kernels.forward(p, x, 2, 30)[0]
    assert np.array_equal(plain, kernels.forward(p, x, 2, 30, 0.0, np.random.default_rng(0))[0])
    assert np.isfinite(kernels.forward(p, x, 2, 30, 1.0, np.random.default_rng(0))[0]).all()


def test_attention_as_relations(spark):
    """The relational attention is that of the kernels."""
    p = kernels.initial(4, 1, 6, 2, 4)
    h = np.random.default_rng(2).normal(size=(6, 4))
    rows = lambda a: spark.createDataFrame([(0, t, d, float(v)) for (t, d), v in np.ndenumerate(a)], "w int, t int, d int, v double")
    q, k, v = h @ p["0.wq"], h @ p["0.wk"], h @ p["0.wv"]
    expected = kernels.softmax(q @ k.T / 2.0) @ v
    found = np.zeros((6, 4))
    for r in linalg.self_attention(rows(q), rows(k), rows(v), ["w"], 4).collect():
        found[r.t, r.d] = r.v
    assert np.allclose(found, expected)


def test_predictions_are_overlap_means(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (75, 31, 9, 0)]
    contigs = spark.createDataFrame([(i, f"s{i}", s, len(s)) for i, s in enumerate(seqs)], "ord int, id string, seq string, length int")
    params = kernels.initial(8, 2, 6, 2, 5)
    found = {(r.ord, r.pos): (r.p0, r.p1, r.p2) for r in annotate.predictions(contigs, params, SMALL).collect()}
    assert len(found) == sum(map(len, seqs))
    for i, s in enumerate(seqs):
        total, n = np.zeros((len(s), 3)), np.zeros(len(s))
        for start in range(0, len(s), 24):
            part = s[start : start + 30]
            if len(part) >= 10:
                total[start : start + len(part)] += kernels.softmax(kernels.forward(params, kernels.features(part, SMALL.cwt_scales), 2, 30)[0])
                n[start : start + len(part)] += 1
        mean = np.divide(total, n[:, None], out=np.zeros_like(total), where=n[:, None] > 0)
        for pos in range(len(s)):
            assert np.allclose(found[i, pos], mean[pos])


def test_batch_gradients_are_sums(spark):
    contigs = spark.createDataFrame([(0, "s", "ACGTTGCAAC" * 6, 60)], "ord int, id string, seq string, length int")
    features = spark.createDataFrame([("s", "exon", 5, 20, "+", "Parent=t"), ("s", "exon", 30, 40, "+", "Parent=t")], "seqid string, feature string, start int, end int, strand string, attributes string")
    wins = annotate.training_windows(contigs, features, SMALL)
    params = kernels.initial(8, 2, 6, 2, 5)
    grads, loss, n = annotate.gradients(wins, params, SMALL, 0)
    rows, total = wins.collect(), 0.0
    expected = {k: np.zeros_like(v) for k, v in params.items()}
    for r in rows:
        x = kernels.features(r.seq, SMALL.cwt_scales)
        logits, caches = kernels.forward(params, x, 2, 30)
        one, delta = kernels.loss_and_gradient(logits, np.array(r.labels))
        total += one
        for k, g in kernels.backward(params, x, caches, delta, 2).items():
            expected[k] += g
    assert n == len(rows)
    assert abs(total - loss) < 1e-9
    assert all(np.allclose(grads[k], expected[k]) for k in params)


def test_training_and_prediction(spark, tmp_path):
    """Train, save, load, predict and write on a made genome; scores stay probabilities, losses fall."""
    rng = random.Random(4)
    seq = "".join(rng.choice("AT") if k % 100 < 50 else rng.choice("CG") for k in range(400))
    (tmp_path / "g.fa").write_text(f">chr\n{seq}\n")
    (tmp_path / "g.gff").write_text("".join(f"chr\tx\texon\t{k + 51}\t{k + 100}\t.\t.\t.\tParent=t{k}\n" for k in range(0, 400, 100)))
    config = Config(d_model=8, num_encoder_layers=1, num_heads=2, d_ff=8, cwt_scales=(2.0, 4.0), window_size=100, window_overlap=20, dropout_rate=0.0, num_epochs=3, batch_size=3, adam_learning_rate=0.02,
                    train_fasta=str(tmp_path / "g.fa"), train_gff=str(tmp_path / "g.gff"), predict_fasta=str(tmp_path / "g.fa"), model_path=str(tmp_path / "m"), output_gff=str(tmp_path / "out.gff"), output_bedgraph=str(tmp_path / "out.bed"))
    losses = [r.loss for r in annotate.train(spark, config, 1).orderBy("epoch").collect()]
    assert losses[-1] < losses[0]
    assert set(load_model(spark, config, config.model_path)) == {name for name, _, _ in kernels.layout(8, 1, 8, 2)}
    cut = annotate.predict(spark, config).orderBy("start").collect()
    assert cut[0].start == 1
    assert cut[-1].end == 400
    lines = [r.value.split("\t") for r in spark.read.text(config.output_bedgraph).collect()]
    assert len(lines) == 400
    assert all(len(x) == 4 and 0 <= float(x[3]) <= 1 for x in lines)
    head = [r.value for r in spark.read.text(config.output_gff).collect()]
    assert head[0] == "##gff-version 3"
