"""Matrices and attention as relations (i, j, v), and the banded convolution join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.plans.kernels import base_signal

#: Bases that a task works on before rows leave it.
CELLS = 1 << 18


def matmul(a: DataFrame, b: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, i, j, v) = a (keys, i, j, v) times b (i, j, v): a join on the inner index, then sums."""
    keys = keys or []
    inner = a.select(*keys, "i", F.col("j").alias("k"), F.col("v").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("v").alias("y")), "k")
    return inner.groupBy(*keys, "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.withColumnsRenamed({"i": "_j", "j": "i"}).withColumnRenamed("_j", "j")


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    other = b.select("i", "j", F.col("v").alias("w"))
    return a.join(other, ["i", "j"], "full").select("i", "j", (F.coalesce("v", F.lit(0.0)) + F.coalesce("w", F.lit(0.0))).alias("v"))


def scale(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * factor)


def row_softmax(a: DataFrame, keys: list[str]) -> DataFrame:
    """Softmax over the rows of ``keys``, by two aggregates joined back: no row is gathered in one place."""
    top = a.groupBy(*keys).agg(F.max("v").alias("m"))
    exps = a.join(top, keys).withColumn("x", F.exp(F.col("v") - F.col("m"))).drop("m")
    total = exps.groupBy(*keys).agg(F.sum("x").alias("s"))
    return exps.join(total, keys).withColumn("v", F.col("x") / F.col("s")).drop("x", "s")


def self_attention(q: DataFrame, k: DataFrame, v: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Scaled dot-product attention inside groups: q, k, v (keys, t, d, v) to (keys, t, d, v).

    Scores are a self-join inside a group, so groups have to be windows of bounded length.
    """
    left = q.select(*keys, "t", "d", F.col("v").alias("x"))
    right = k.select(*keys, F.col("t").alias("u"), "d", F.col("v").alias("y"))
    scores = left.join(right, [*keys, "d"]).groupBy(*keys, "t", "u").agg((F.sum(F.col("x") * F.col("y")) / math.sqrt(width)).alias("v"))
    weights = row_softmax(scores, [*keys, "t"]).withColumnRenamed("v", "_weight")
    values = v.select(*keys, F.col("t").alias("u"), "d", "v")
    return weights.join(values, [*keys, "u"]).groupBy(*keys, "t", "d").agg(F.sum(F.col("_weight") * F.col("v")).alias("v"))


def convolve(signal: DataFrame, kernel: DataFrame, length: int, keys: list[str], n: str = "n") -> DataFrame:
    """(keys, pos, re, im): the centred part of the linear convolution of complex rows.

    ``signal(keys, n, pos, re, im)``, ``kernel(k, kre, kim)`` of ``length`` samples. Each sample goes to the
    outputs it reaches by arithmetic, an explode of ``length`` rows, so that the band is not a theta join.
    """
    centre = length // 2
    spread = signal.select(*keys, n, "re", "im", F.col("pos"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k"))
    placed = spread.withColumn("out", F.col("pos") + F.col("k") - centre).where(f"out >= 0 AND out < {n}")
    met = placed.join(F.broadcast(kernel), "k")  # as many rows as the kernel has samples
    re, im = F.col("re") * F.col("kre") - F.col("im") * F.col("kim"), F.col("re") * F.col("kim") + F.col("im") * F.col("kre")
    return met.groupBy(*keys, F.col("out").alias("pos")).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def convolve_texts(rows: DataFrame, keys: list[str], seq: str, taps: np.ndarray, cells: int = CELLS) -> DataFrame:
    """(keys, pos, re, im): ``convolve`` of the signals of texts, where each text stands: nothing is shuffled or gathered, and
    rows leave a task when about ``cells`` bases are done."""
    gap = len(taps) - 1

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(seq).to_pylist()
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            group = np.cumsum(sizes) // cells
            cuts = np.unique([0, *(np.flatnonzero(np.diff(group)) + 1), len(texts)])
            for a, b in zip(cuts, cuts[1:]):
                some, n = texts[a:b], sizes[a:b]
                full = np.convolve(base_signal([("N" * gap).join(some)])[0], taps)
                place = np.repeat(np.cumsum(n) - n, n)
                pos = np.arange(n.sum()) - place
                out = full[np.repeat(np.cumsum(n + gap) - n - gap, n) + pos + len(taps) // 2]
                own = pa.array(np.repeat(np.arange(a, b), n))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in keys), pa.array(pos.astype(np.int32)), pa.array(out.real.copy()), pa.array(out.imag.copy())], [*keys, "pos", "re", "im"])

    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.where(F.length(seq) > 0).select(*keys, seq).mapInArrow(made, ", ".join([*kinds, "pos int, re double, im double"]))


def dft(samples: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """(keys, f, re, im) of n real samples (keys, k, x), by the defining sum."""
    spread = samples.select(*keys, "k", "x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("f"))
    angle = F.lit(2 * math.pi) * F.col("k") * F.col("f") / F.lit(float(n))
    return spread.groupBy(*keys, "f").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(-F.col("x") * F.sin(angle)).alias("im"))
