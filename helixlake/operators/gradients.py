"""Reverse mode as relations: gradients of rows of windows, of weights as sums over all rows, and Adam steps on tables.

Rows are (keys, t, x, dy): what a part read and the gradient of what it gave. Gradients of weights are relations
(name, i, j, v), summed where the rows are before they are shuffled. Parameters are relations too, beside their
moments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.functions.binding import let
from helixlake.functions.numeric import LAYER_NORM_EPS, softmax
from helixlake.operators.attention import dot, heads_of, matrix_of, multiplied, product, with_weights


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def softmax_delta(logits: Column, label: Column) -> Column:
    """Gradient of the cross-entropy by the logits: probabilities less one at the label; zeros for a label of no class."""
    known = (label >= 0) & (label < F.size(logits))
    delta = let(softmax(logits), lambda p: F.transform(p, lambda v, k: v - (k == label).cast("double")))
    return F.when(known, delta).otherwise(F.transform(logits, lambda v: F.lit(0.0)))


def relu_back(dy: Column, y: Column) -> Column:
    """``y``: what relu gave."""
    return F.zip_with(dy, y, lambda d, v: F.when(v > 0, d).otherwise(0.0))


def product_back(dy: Column, rows: Column) -> Column:
    """dy times the transposed matrix, given as the array of its rows."""
    return F.transform(rows, lambda r: dot(r, dy))


def layer_norm_back(dy: Column, x: Column, gamma: Column) -> Column:
    """struct<dx, dgamma>: gradients by the values and the row's part of that by gamma (that by beta is dy)."""

    def made(v: Column, mean: Column, deviation: Column) -> Column:
        unit = F.transform(v, lambda e: (e - mean) / deviation)

        def back(u: Column, du: Column) -> Column:
            n = F.size(u)
            return let(total(du) / n, lambda m: let(dot(du, u) / n, lambda c: F.struct(F.zip_with(du, u, lambda d, e: (d - m - e * c) / deviation).alias("dx"), F.zip_with(dy, u, lambda d, e: d * e).alias("dgamma"))))

        return let(unit, lambda u: let(F.zip_with(dy, gamma, lambda d, g: d * g), lambda du: back(u, du)))

    def deviated(v: Column, mean: Column) -> Column:
        variance = F.aggregate(v, F.lit(0.0), lambda s, e: s + (e - mean) * (e - mean)) / F.size(v)
        return let(F.sqrt(variance + LAYER_NORM_EPS), lambda d: made(v, mean, d))

    return let(x, lambda v: let(total(v) / F.size(v), lambda m: deviated(v, m)))


def weight_gradient(rows: DataFrame, x: str, dy: str, name: str) -> DataFrame:
    """(name, i, j, v): the sum of x_i dy_j over all rows. Tasks sum their own rows first."""
    cells = rows.select(F.posexplode(x).alias("i", "_x"), dy).select("i", "_x", F.posexplode(dy).alias("j", "_d"))
    return cells.groupBy("i", "j").agg(F.sum(F.col("_x") * F.col("_d")).alias("v")).select(F.lit(name).alias("name"), "i", "j", "v")


def vector_gradient(rows: DataFrame, dy: str, name: str) -> DataFrame:
    """(name, i = 0, j, v): the sum of dy over all rows."""
    summed = rows.select(F.posexplode(dy).alias("j", "_d")).groupBy("j").agg(F.sum("_d").alias("v"))
    return summed.select(F.lit(name).alias("name"), F.lit(0).alias("i"), "j", "v")


def _weighed(values: Column, weights: Column, width: int) -> Column:
    """Sum of arrays, each times its weight."""
    nothing = F.array_repeat(F.lit(0.0), width)
    return F.aggregate(F.arrays_zip(weights.alias("_a"), values.alias("_b")), nothing, lambda s, p: F.zip_with(s, p["_b"], lambda a, b: a + p["_a"] * b))


def attention_back(rows: DataFrame, weights: dict[str, DataFrame], keys: list[str], heads: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Gradients of multi-head attention: (keys, t, dx) and (name, i, j, v) of wq, wk, wv and wo.

    ``rows``: keys, t, x, dy. What a query row has of its own is made where it stands; what keys and values gather from
    all queries of their window meets them there as one array, as keys and values met the queries before.
    """
    size = width // heads
    scale = 1 / math.sqrt(size)
    names = ("wq", "wk", "wv")
    placed = multiplied(rows.select(*keys, "t", "x", "dy"), "x", "_p", *(matrix_of(weights[n]) for n in names))
    placed = multiplied(placed, "dy", "_m", matrix_of(weights["wo"]).T)
    parts = [heads_of(F.slice("_p", k * width + 1, width), heads, width).alias(n[1]) for k, n in enumerate(names)]
    # dy times the transposed matrix is the gradient of what the heads mixed
    split = placed.select(*keys, "t", "x", "dy", *parts, heads_of(F.col("_m"), heads, width).alias("m"))
    tile = split.select(*keys, "t", F.posexplode(F.arrays_zip("q", "k", "v", "m")).alias("_head", "_p"))
    whole = tile.groupBy(*keys, "_head").agg(F.array_sort(F.collect_list(F.struct("t", "_p.k", "_p.v"))).alias("_seen"))
    met = tile.select(*keys, "_head", "t", "_p").join(whole, [*keys, "_head"])
    q, dm = F.col("_p.q"), F.col("_p.m")
    scored = met.withColumn("_w", softmax(F.transform("_seen", lambda s: dot(q, s["k"]) * scale)))
    scored = scored.withColumn("_da", F.transform("_seen", lambda s: dot(dm, s["v"])))
    scored = scored.withColumn("_c", dot(F.col("_w"), F.col("_da")))
    scored = scored.withColumn("_ds", F.zip_with("_w", "_da", lambda w, d: w * (d - F.col("_c")) * scale))
    own = scored.select(
        *keys, "_head", "t", "_ds", "_w", q.alias("_q"), dm.alias("_dm"),
        _weighed(F.transform("_seen", lambda s: s["k"]), F.col("_ds"), size).alias("_dq"),
        _weighed(F.transform("_seen", lambda s: s["v"]), F.col("_w"), size).alias("_mixed"),
        F.array_position(F.transform("_seen", lambda s: s["t"]), F.col("t")).cast("int").alias("_at"),
    )
    asked = own.groupBy(*keys, "_head").agg(F.array_sort(F.collect_list(F.struct("t", "_ds", "_w", "_q", "_dm"))).alias("_all"))
    both = own.select(*keys, "_head", "t", "_dq", "_mixed", "_at").join(asked, [*keys, "_head"])
    mine = lambda name: F.transform("_all", lambda s: F.get(s[name], F.col("_at") - 1))
    dk = _weighed(F.transform("_all", lambda s: s["_q"]), mine("_ds"), size)
    dv = _weighed(F.transform("_all", lambda s: s["_dm"]), mine("_w"), size)
    back = both.select(*keys, "_head", "t", "_dq", dk.alias("_dk"), dv.alias("_dv"), "_mixed")
    gathered = back.groupBy(*keys, "t").agg(F.array_sort(F.collect_list(F.struct("_head", "_dq", "_dk", "_dv", "_mixed"))).alias("_h"))
    flat = lambda name: F.flatten(F.transform("_h", lambda s: s[name])).alias(name)
    joined = rows.join(gathered.select(*keys, "t", *map(flat, ("_dq", "_dk", "_dv", "_mixed"))), [*keys, "t"])
    grads = weight_gradient(joined, "_mixed", "dy", "wo")
    for n in names:
        grads = grads.unionByName(weight_gradient(joined, "x", f"_d{n[1]}", n))
    turned = {f"_t{n}": weights[n].select(F.col("j").alias("i"), F.col("i").alias("j"), "v") for n in names}
    three = [product(F.col(f"_d{n[1]}"), F.col(f"_t{n}")) for n in names]
    dx = F.zip_with(F.zip_with(three[0], three[1], lambda a, b: a + b), three[2], lambda a, b: a + b)
    return with_weights(joined, **turned).select(*keys, "t", dx.alias("dx")), grads


def adam_step(state: DataFrame, gradients: DataFrame, step: int, rate: float, beta1: float, beta2: float, eps: float) -> DataFrame:
    """(name, i, j, v, m, u) after one bias-corrected step on parameters v with moments m and u; ``step`` counts from 1.

    A parameter without a gradient has one of zero. The state joins the gradients by cell, so that it may be larger than a
    machine.
    """
    g = F.coalesce("_g", F.lit(0.0))
    met = state.join(gradients.select("name", "i", "j", F.col("v").alias("_g")), ["name", "i", "j"], "left")
    moved = met.withColumns({"m": beta1 * F.col("m") + (1 - beta1) * g, "u": beta2 * F.col("u") + (1 - beta2) * g * g})
    change = rate * (F.col("m") / (1 - beta1**step)) / (F.sqrt(F.col("u") / (1 - beta2**step)) + eps)
    return moved.select("name", "i", "j", (F.col("v") - change).alias("v"), "m", "u")
