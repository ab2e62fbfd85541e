"""The fast Fourier transform of arrays, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixlake.functions.binding import let


def _reversed_bits(n: int) -> list[int]:
    bits = n.bit_length() - 1
    return [int(f"{i:0{bits}b}"[::-1], 2) if bits else 0 for i in range(n)]


def _numbers(values: list[float] | list[int], kind: str) -> Column:
    """A constant array, read from text: one literal, however long it is."""
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), f"array<{kind}>")


def fft(re: Column, im: Column | None, n: int, inverse: bool = False) -> Column:
    """array<struct<re,im>> of the transform of n complex samples; n is a power of two.

    Samples are put in the order of reversed bits; then log2(n) stages of butterflies, each one pass over the
    array, without a row per sample. Shorter arrays are filled with zeros, longer ones cut; the inverse is scaled by 1 / n.
    """
    if n < 1 or n & (n - 1):
        raise ValueError("the length must be a power of two")
    turn = 2 * math.pi / n * (1 if inverse else -1)
    zero = F.lit(0.0)

    def sample(values: Column | None, i: Column) -> Column:
        return zero if values is None else F.coalesce(F.get(values, i), zero)

    def placed(order: Column) -> Column:
        return F.transform(order, lambda i: F.struct(sample(re, i).alias("re"), sample(im, i).alias("im")))

    def stage(x: Column, half: int, cos: Column, sin: Column) -> Column:
        def butterfly(i: Column) -> Column:
            low = i.bitwiseAND(F.lit(half)) == 0
            a = F.when(low, i).otherwise(i - half)
            k = i.bitwiseAND(F.lit(half - 1)) * (n // (2 * half))
            sign = F.when(low, 1.0).otherwise(-1.0)

            def of(p: Column, q: Column) -> Column:
                return let(
                    F.struct(F.get(cos, k).alias("c"), F.get(sin, k).alias("s")),
                    lambda w: F.struct(
                        (p["re"] + sign * (q["re"] * w["c"] - q["im"] * w["s"])).alias("re"),
                        (p["im"] + sign * (q["re"] * w["s"] + q["im"] * w["c"])).alias("im"),
                    ),
                )

            return let(F.get(x, a), lambda p: let(F.get(x, a + half), lambda q: of(p, q)))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), butterfly)

    def stages(x: Column, half: int, cos: Column, sin: Column) -> Column:
        if half == n:
            return F.transform(x, lambda z: F.struct((z["re"] / n).alias("re"), (z["im"] / n).alias("im"))) if inverse else x
        return let(stage(x, half, cos, sin), lambda y: stages(y, 2 * half, cos, sin))

    angles = [turn * k for k in range(max(n // 2, 1))]
    cos, sin = (_numbers([f(a) for a in angles], "double") for f in (math.cos, math.sin))
    return let(cos, lambda c: let(sin, lambda s: let(placed(_numbers(_reversed_bits(n), "int")), lambda x: stages(x, 1, c, s))))
