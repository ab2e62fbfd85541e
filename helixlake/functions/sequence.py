"""DNA strings as Spark columns: complements, the complex signal of the bases, substrings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def complement(seq: Column) -> Column:
    """A and T, G and C swapped, upper case; everything else N. ASCII only, so lengths never change."""
    return F.regexp_replace(F.translate(seq, "ATGCatgc", "TACGTACG"), "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def base_re(base: Column) -> Column:
    """Real part of a base's signal: A and T 1, G and C -1, else 0."""
    return F.when(base.isin("A", "a", "T", "t"), 1.0).when(base.isin("G", "g", "C", "c"), -1.0).otherwise(0.0)


def base_im(base: Column) -> Column:
    """Imaginary part of a base's signal: A and G 1, T and C -1, else 0."""
    return F.when(base.isin("A", "a", "G", "g"), 1.0).when(base.isin("T", "t", "C", "c"), -1.0).otherwise(0.0)


def signal(df: DataFrame, seq: str, *keep: str) -> DataFrame:
    """(keep, pos, re, im): a row per base. Spark has no complex type, so the parts are two columns."""
    bases = df.where(F.length(seq) > 0).select(*keep, F.posexplode(F.split(seq, "")).alias("pos", "base"))
    return bases.select(*keep, "pos", base_re(F.col("base")).alias("re"), base_im(F.col("base")).alias("im"))


_PARTS = np.zeros((2, 256))
for _base, _re, _im in (("A", 1, 1), ("T", 1, -1), ("G", -1, 1), ("C", -1, -1)):
    for _code in (ord(_base), ord(_base.lower())):
        _PARTS[:, _code] = _re, _im
_MOMENTS = T.StructType([T.StructField(name, T.DoubleType()) for name in ("re", "im", "re_pos", "im_pos")])


@F.pandas_udf(_MOMENTS)
def signal_moments(seqs: pd.Series) -> pd.DataFrame:
    """Sums of the signal of a string's characters, plain and weighted by their places, without a row per base."""
    rows = []
    for seq in seqs:
        codes = np.frombuffer((seq or "").encode("utf-32-le"), dtype=np.uint32)
        parts = _PARTS[:, np.minimum(codes, 255)]
        rows.append((*parts.sum(axis=1), *(parts @ np.arange(len(codes), dtype=float))))
    return pd.DataFrame(rows, columns=_MOMENTS.names)


def window_text(seq: Column, start: Column, length: Column) -> Column:
    """The substring that starts at a 0-based position."""
    return F.substr(seq, (start + 1).cast("int"), length.cast("int"))
