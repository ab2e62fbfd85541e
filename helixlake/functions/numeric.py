"""Numeric expressions: wavelets, position codes, and row operations on arrays of doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions.binding import let

LAYER_NORM_EPS = 1e-6


def next_power_of_two(n: Column) -> Column:
    """Least power of two that is at least n; 1 for n up to 1. In integers."""
    return F.when(n <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1), F.length(F.bin(n.cast("bigint") - 1)).cast("int")))


def bit_reversed(i: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(i.cast("bigint")), bits, "0")), 2, 10).cast("bigint")


def wavelet_length(scale: Column, n: Column) -> Column:
    """Ten scales (rounded down, 1 at least), n at most, made odd by adding one."""
    length = F.least(F.greatest(F.floor(scale * 10), F.lit(1)), n).cast("int")
    return length + F.when(length % 2 == 0, 1).otherwise(0)


def morlet(k: Column, scale: Column, length: Column) -> tuple[Column, Column]:
    """Real and imaginary part of sample k: a Gaussian times a turn of e^(2 pi i t), t in scales from the centre."""
    t = (k - F.floor(length / 2)) / scale
    size = F.exp(-(t * t) / 2) / F.sqrt(scale * F.lit(math.pi**0.25))
    return size * F.cos(F.lit(2 * math.pi) * t), size * F.sin(F.lit(2 * math.pi) * t)


def wavelet_bank(spark: SparkSession, scales: list[float], n: int) -> DataFrame:
    """(scale_idx, scale, length, k, re, im) of every scale, for sequences of n bases."""
    rows = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scales)], "scale_idx int, scale double")
    sized = rows.withColumn("length", wavelet_length(F.col("scale"), F.lit(n)))
    flat = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("k"))
    re, im = morlet(F.col("k"), F.col("scale"), F.col("length"))
    return flat.select("scale_idx", "scale", "length", "k", re.alias("re"), im.alias("im"))


def position_code(t: Column, i: Column, d_model: int) -> Column:
    """Sinusoidal code of position t in dimension i: even sines, odd cosines."""
    angle = t / F.pow(F.lit(10000.0), (F.lit(2) * F.floor(i / 2)) / F.lit(float(d_model)))
    return F.when(i % 2 == 0, F.sin(angle)).otherwise(F.cos(angle))


def position_table(spark: SparkSession, length: int, d_model: int) -> DataFrame:
    """(t, i, v)."""
    grid = spark.range(length).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(d_model - 1))).alias("i"))
    return grid.select("t", "i", position_code(F.col("t"), F.col("i"), d_model).alias("v"))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def softmax(values: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""

    def of_exps(exps: Column) -> Column:
        return let(F.aggregate(exps, F.lit(0.0), lambda n, x: n + x), lambda total: F.transform(exps, lambda e: e / total))

    return let(values, lambda v: let(F.array_max(v), lambda top: let(F.transform(v, lambda x: F.exp(x - top)), of_exps)))


def argmax(values: Column) -> Column:
    """Place of the first greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def class_of(p0: Column, p1: Column, p2: Column) -> Column:
    """Argmax of three columns; ties and NaN go to the lowest class."""
    one = (p1 > p0) & ~F.isnan(p1)
    best = F.when(one, p1).otherwise(p0)
    return F.when((p2 > best) & ~F.isnan(p2), 2).when(one, 1).otherwise(0)


def layer_norm(values: Column, gamma: Column | None = None, beta: Column | None = None) -> Column:
    """Array scaled to mean 0 and population variance 1, then by gamma and beta."""

    def normal(v: Column) -> Column:
        n = F.size(v)
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n

        def centred(m: Column) -> Column:
            variance = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n
            return let(F.sqrt(variance + LAYER_NORM_EPS), lambda d: F.transform(v, lambda x: (x - m) / d))

        return let(mean, centred)

    made = let(values, normal)
    scaled = F.zip_with(made, gamma, lambda x, g: x * g) if gamma is not None else made
    return F.zip_with(scaled, beta, lambda x, b: x + b) if beta is not None else scaled


def log_softmax_at(values: Column, target: Column) -> Column:
    """Log probability of a class; null if the class isn't there."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.get(values, target.cast("int")) - top - F.log(total)


#: Modulus and multiplier of the generator behind dropout, a prime and a root of it.
DROP_MODULUS, DROP_FACTOR = 2_147_483_647, 48_271


def drop_draw(*numbers: Column) -> Column:
    """A number from 0 to 1, exclusive, drawn from whole numbers: the same wherever and whenever it is asked for.

    Each number is added and the sum multiplied twice, modulo a prime, squared in between; products stay in 64 bits.
    """
    u = F.lit(1).cast("bigint")
    for number in numbers:
        u = (u + F.pmod(number.cast("bigint"), F.lit(DROP_MODULUS))) * DROP_FACTOR % DROP_MODULUS
        u = (u * u % DROP_MODULUS + 1) * DROP_FACTOR % DROP_MODULUS
    return u / float(DROP_MODULUS)


def dropped_out(x: Column, rate: float, *numbers: Column) -> Column:
    """Inverted dropout: 0 with the given probability, else scaled so that the mean stays.

    The numbers, such as step, layer, window, row and column, decide: the backward pass and a task that runs again
    drop the same values.
    """
    if rate <= 0:
        return x
    if rate >= 1:
        return x * 0.0
    return F.when(drop_draw(*numbers) < rate, 0.0).otherwise(x / (1 - rate))
