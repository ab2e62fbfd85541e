"""Gradients as relations against the kernel's, which finite differences hold; dropout; steps; training that goes on."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixlake.functions import numeric
from helixlake.operators import gradients
from helixlake.plans import annotate, kernels
from helixlake.sources.config import Config


def relation(spark, m):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i int, j int, v double")


def dense(rows, shape):
    out = np.zeros(shape)
    for r in rows:
        out[r.i, r.j] = r.v
    return out


def loss_of(x, dy, p, heads):
    q, k, v = (kernels.heads_of(x @ p[n], heads) for n in ("wq", "wk", "wv"))
    a = kernels.softmax(q @ k.swapaxes(-1, -2) / np.sqrt(q.shape[-1]))
    return float((kernels.joined(a @ v) @ p["wo"] * dy).sum())


def test_attention_back_against_finite_differences(spark):
    rng = np.random.default_rng(2)
    width, heads = 6, 2
    p = {n: rng.normal(size=(width, width)) / 2 for n in ("wq", "wk", "wv", "wo")}
    groups = {w: (rng.normal(size=(n, width)), rng.normal(size=(n, width))) for w, n in (("a", 5), ("b", 1), ("c", 3))}
    rows = [(w, 3 * t, x[t].tolist(), dy[t].tolist()) for w, (x, dy) in groups.items() for t in range(len(x))]
    df = spark.createDataFrame(rows, "w string, t int, x array<double>, dy array<double>")
    dx, grads = gradients.attention_back(df, {n: relation(spark, m) for n, m in p.items()}, ["w"], heads, width)
    found, h = grads.collect(), 1e-5

    def slope(m, at):
        before = m[at]
        m[at] = before + h
        up = sum(loss_of(x, dy, p, heads) for x, dy in groups.values())
        m[at] = before - h
        down = sum(loss_of(x, dy, p, heads) for x, dy in groups.values())
        m[at] = before
        return (up - down) / (2 * h)

    for n in p:
        got = dense([r for r in found if r.name == n], (width, width))
        for at in [(0, 0), (1, 4), (5, 5), (3, 2)]:
            assert abs(got[at] - slope(p[n], at)) < 1e-6, n
    by_row = {(r.w, r.t): r.dx for r in dx.collect()}
    assert len(by_row) == len(rows)
    for w, (x, _) in groups.items():
        for t in range(len(x)):
            assert all(abs(by_row[w, 3 * t][d] - slope(x, (t, d))) < 1e-6 for d in (0, 3, 5))


def test_norm_and_softmax_back(spark):
    rng = np.random.default_rng(4)
    x, dy, gamma = rng.normal(size=(4, 7)), rng.normal(size=(4, 7)), rng.normal(size=7)
    df = spark.createDataFrame([(t, x[t].tolist(), dy[t].tolist(), gamma.tolist(), int(t) - 1) for t in range(4)], "t int, x array<double>, dy array<double>, g array<double>, label int")
    rows = df.withColumn("b", gradients.layer_norm_back(F.col("dy"), F.col("x"), F.col("g"))).withColumn("d", gradients.softmax_delta(F.col("x"), F.col("label")))
    out, cache = kernels.norm(x, gamma, np.zeros(7))
    dx, dgamma, dbeta = kernels.norm_back(dy, gamma, cache)
    got = rows.orderBy("t").collect()
    assert np.allclose([r.b.dx for r in got], dx) and np.allclose(np.sum([r.b.dgamma for r in got], axis=0), dgamma[0])
    summed = {r.j: r.v for r in gradients.vector_gradient(df, "dy", "e").collect()}
    assert np.allclose([summed[j] for j in range(7)], dbeta[0])
    _, delta = kernels.loss_and_gradient(x, np.arange(4) - 1)
    assert np.allclose([r.d for r in got], delta * 4)
    assert np.allclose(dense(gradients.weight_gradient(df, "x", "dy", "w").collect(), (7, 7)), x.T @ dy)


def test_adam_steps_equal_the_kernel(spark):
    rng = np.random.default_rng(6)
    p = {"a": rng.normal(size=(3, 2)), "b": rng.normal(size=(1, 4))}
    frame = lambda d: spark.createDataFrame([(n, i, j, float(m[i, j])) for n, m in d.items() for i in range(m.shape[0]) for j in range(m.shape[1])], "name string, i int, j int, v double")
    state = frame(p).withColumns({"m": F.lit(0.0), "u": F.lit(0.0)})
    moments: dict = {}
    for step in (1, 2, 3):
        g = {n: rng.normal(size=m.shape) for n, m in p.items()}
        state = spark.createDataFrame(gradients.adam_step(state, frame(g), step, 0.02, 0.9, 0.98, 1e-8).collect(), "name string, i int, j int, v double, m double, u double")
        kernels.adam(p, g, moments, step, 0.02, 0.9, 0.98, 1e-8)
    for n, m in p.items():
        assert np.allclose(dense([r for r in state.collect() if r.name == n], m.shape), m)
    still = gradients.adam_step(state, frame({}), 4, 0.02, 0.9, 0.98, 1e-8)
    assert still.count() == state.count()


def test_dropout_is_the_same_everywhere(spark):
    """The mask of a window is that of the columns, at the given rate, and another one for another step."""
    mask = kernels.dropout_mask((40, 30), 0.3, 5, 123_456_789_012, 1)
    grid = spark.range(40).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("c"))
    value = numeric.dropped_out(F.lit(1.0), 0.3, F.lit(5), F.lit(123_456_789_012), F.lit(1), F.col("r"), F.col("c"))
    got = np.zeros((40, 30))
    for r in grid.repartition(3).withColumn("v", value).collect():
        got[r.r, r.c] = r.v
    assert np.array_equal(got, mask)
    assert 0.25 < (mask == 0).mean() < 0.35 and not np.array_equal(mask, kernels.dropout_mask((40, 30), 0.3, 6, 123_456_789_012, 1))
    assert spark.range(1).select(numeric.dropped_out(F.lit(2.0), 0, F.lit(1)), numeric.dropped_out(F.lit(2.0), 1, F.lit(1))).first() == (2.0, 0.0)


def test_gradients_with_dropout_are_of_the_same_mask():
    p, drawn = kernels.initial(8, 1, 6, 2, 4), (3, 1, 40, 0)
    x, y = kernels.features("ACGTTGCAACGTAC", (2.0, 3.0)), np.arange(14) % 3
    logits, caches = kernels.forward(p, x, 2, 30, 0.4, drawn)
    grads = kernels.backward(p, x, caches, kernels.loss_and_gradient(logits, y)[1], 2)
    loss = lambda: kernels.loss_and_gradient(kernels.forward(p, x, 2, 30, 0.4, drawn)[0], y)[0]
    for name in ("projection", "0.w2", "0.wo"):
        before = p[name][1, 2]
        p[name][1, 2] = before + 1e-5
        up = loss()
        p[name][1, 2] = before - 1e-5
        down = loss()
        p[name][1, 2] = before
        assert abs((up - down) / 2e-5 - grads[name][1, 2]) < 1e-6


def test_training_goes_on_after_a_stop(spark, tmp_path):
    config = Config(d_model=8, num_encoder_layers=1, num_heads=2, d_ff=8, cwt_scales=(2.0,), window_size=30, window_overlap=6, num_epochs=3, batch_size=2, dropout_rate=0.2, adam_learning_rate=0.01)
    contigs = spark.createDataFrame([(0, "s", "ACGTTGCAAC" * 9, 90)], "ord int, id string, seq string, length int")
    features = spark.createDataFrame([("s", "exon", 5, 20, "+", "Parent=t"), ("s", "exon", 30, 40, "+", "Parent=t")], "seqid string, feature string, start int, end int, strand string, attributes string")
    wins = annotate.training_windows(contigs, features, config)
    whole, losses = annotate.fit(wins, config, 3)
    path = str(tmp_path / "state")
    annotate.fit(wins, replace(config, num_epochs=2), 3, path)
    (tmp_path / "state" / "epoch=7").mkdir()  # a write that was not committed
    resumed, again = annotate.fit(wins, config, 3, path)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, losses.collect())) and again.count() == 3
    assert all(np.allclose(resumed[n], whole[n], atol=1e-12) for n in whole)
    done, _ = annotate.fit(wins, config, 3, path)  # nothing is left to do
    assert all(np.array_equal(done[n], resumed[n]) for n in done)


def test_windows_of_several_lengths_are_worked_on_together():
    """Losses and gradients of windows laid out side by side, dropout included, are those of each one."""
    p, seqs = kernels.initial(8, 2, 6, 2, 4), ["ACGTTGCAACGTAC", "ACGTTGCAACGTACCAG", "TTTTACGGCA", "ACGTTGCAACGTAA"]
    labels = [[k % 4 - (k == 2) for k in range(len(s))] for s in seqs]
    x, y, lengths = kernels.laid_out(seqs, labels, (2.0, 3.0))
    numbers = np.arange(len(seqs))[:, None, None]
    logits, caches = kernels.forward(p, x, 2, 30, 0.4, (3, numbers, 7), lengths)
    losses, delta = kernels.loss_and_gradient(logits, y, lengths)
    grads, expected = kernels.backward(p, x, caches, delta, 2), {n: 0 for n in p}
    for k, (s, one) in enumerate(zip(seqs, labels)):
        own = kernels.features(s, (2.0, 3.0))
        logits, caches = kernels.forward(p, own, 2, 30, 0.4, (3, k, 7))
        loss, delta = kernels.loss_and_gradient(logits, np.array(one))
        assert abs(loss - losses[k]) < 1e-12
        expected = {n: expected[n] + g for n, g in kernels.backward(p, own, caches, delta, 2).items()}
    assert all(np.allclose(grads[n], expected[n], atol=1e-12) for n in p)
    assert sorted(sum(kernels.groups([9, 20, 10, 9], 2, 400), [])) == [0, 1, 2, 3] and len(kernels.groups([9, 20, 10, 9], 2, 400)) == 3


@pytest.mark.parametrize("chunk", [annotate.CHUNK, 100])
def test_a_step_reads_the_partitions_of_its_batch(spark, monkeypatch, chunk):
    monkeypatch.setattr(annotate, "HELD", 4)
    monkeypatch.setattr(annotate, "SLICE", 4)
    monkeypatch.setattr(annotate, "CHUNK", chunk)
    config = Config(d_model=8, num_encoder_layers=1, num_heads=2, d_ff=8, cwt_scales=(2.0,), window_size=30, window_overlap=6, num_epochs=1, batch_size=8, dropout_rate=0.2)
    contigs = spark.range(40).select(F.col("id").cast("int").alias("ord"), F.col("id").cast("string").alias("id"), F.repeat(F.lit("ACGTTGCAAC"), F.lit(4)).alias("seq"), F.lit(40).alias("length"))
    features = spark.createDataFrame([(str(k), "exon", 5, 20, ".", "Parent=t") for k in range(40)], "seqid string, feature string, start int, end int, strand string, attributes string")
    wins, params = annotate.training_windows(contigs, features, config), kernels.initial(8, 1, 8, 1, 5)
    dealt = annotate.Dealt(wins, 20, wins.count(), config)
    assert max(map(len, dealt.places.values())) <= 2 < dealt.rows.getNumPartitions()
    made = [dealt.gradients(b, params, 3) for b in range(20)]
    whole, loss, n = annotate.gradients(wins, params, config, 3)
    assert sum(m[2] for m in made) == n == wins.count() and abs(sum(m[1] for m in made) - loss) < 1e-9
    assert all(np.allclose(sum(m[0][k] for m in made), whole[k]) for k in params)


@pytest.mark.parametrize("section", [annotate.SECTION, 12])
def test_light_steps_follow_each_other_in_few_jobs(spark, monkeypatch, section):
    """As many jobs as there are sections of steps, not one for each step, with the losses and weights of a job for each."""
    monkeypatch.setattr(annotate, "SECTION", section)
    config = Config(d_model=8, num_encoder_layers=1, num_heads=2, d_ff=8, cwt_scales=(2.0,), window_size=30, window_overlap=6, num_epochs=2, batch_size=3, dropout_rate=0.2, adam_learning_rate=0.01)
    contigs = spark.range(40).select(F.col("id").cast("int").alias("ord"), F.col("id").cast("string").alias("id"), F.substr(F.repeat(F.lit("ACGTTGCAAC"), F.lit(5)), F.lit(1), F.lit(30) + F.col("id").cast("int") % 20).alias("seq")).withColumn("length", F.length("seq"))
    features = spark.createDataFrame([(str(k), "exon", 5, 20, ".", "Parent=t") for k in range(40)], "seqid string, feature string, start int, end int, strand string, attributes string")
    wins = annotate.training_windows(contigs, features, config).persist()
    steps, sections = -(-wins.count() // 3), -(-(-(-wins.count() // 3)) // max(1, section // 3))
    spark.sparkContext.setJobGroup("light", "light")
    params, losses = annotate.fit(wins, config, 3)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("light"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 2 * sections <= jobs <= 2 * sections + 20 < 2 * steps
    monkeypatch.setattr(annotate, "LIGHT", 0)
    one, each = annotate.fit(wins, config, 3)
    for a, b in zip(losses.collect(), each.collect(), strict=True):
        assert (a.epoch, a.windows) == (b.epoch, b.windows) and abs(a.loss - b.loss) < 1e-12
    assert all(np.allclose(params[n], one[n], atol=1e-12) for n in one)
    wins.unpersist()


def test_light_and_heavy_steps():
    small = Config(d_model=16, num_encoder_layers=1, num_heads=2, d_ff=16, cwt_scales=(2.0, 4.0))
    p = kernels.initial(16, 1, 16, 2, 0)
    assert annotate.light(p, 512 * 25 * 10, 512 * 625 * 10, 10, small)
    assert not annotate.light(p, 512 * 5000 * 10, 512 * 5000**2 * 10, 10, small)
    assert not annotate.light(kernels.initial(512, 6, 2048, 5, 0), 250, 6250, 10, Config())


def test_softmax_of_far_logits():
    x = np.array([[1e4, 1e4 - 1, -1e4], [-1e4, -1e4 - 1, 3e4]])
    e = np.exp(np.array([0.0, -1.0]))
    inside = np.array([1.0, 1.0, 0.0])
    assert np.allclose(kernels.softmax(x, inside), np.r_[e / e.sum(), 0.0]) and np.allclose(kernels.softmax(x[:1])[0], np.r_[e / e.sum(), 0.0])
    assert np.allclose(kernels.softmax(x / 100, inside), kernels.softmax(x / 100 - 400, inside)) and np.allclose(kernels.softmax(x / 100, inside)[:, 2], 0)


def test_short_windows_have_the_features_of_long_ones(monkeypatch):
    found = kernels.features(["ACGTTGCAACGTN", "TTTTACGGCATGA"], (0.5, 2.0, 30.0))
    monkeypatch.setattr(kernels, "SHORT", 0)
    assert np.allclose(found, kernels.features(["ACGTTGCAACGTN", "TTTTACGGCATGA"], (0.5, 2.0, 30.0)), atol=1e-12)
