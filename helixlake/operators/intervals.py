"""Joins of windows with intervals by bins of growing size.

An interval stands in the bins of the first size that is longer than it, two at most, however long it is. A window
looks into the bins that it touches of every size, two of each at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each size of bin is so many times the one before; beyond the last one bin holds all.
FACTOR, LEVELS = 32, 6


def _sizes(smallest: int) -> list[int]:
    return [smallest * FACTOR**level for level in range(LEVELS)]


def _bin(level: int, number: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), number.cast("long").alias("number"))


def interval_bins(b: Column, e: Column, smallest: int) -> Column:
    """The bins that hold the closed interval."""
    found = F.array(_bin(LEVELS, F.lit(0)))
    for level, size in reversed(list(enumerate(_sizes(smallest)))):
        first, last = F.floor(b / size), F.floor(e / size)
        held = F.when(first == last, F.array(_bin(level, first))).otherwise(F.array(_bin(level, first), _bin(level, last)))
        found = F.when(e - b < size, held).otherwise(found)
    return found


def touched_bins(b: Column, e: Column, smallest: int) -> Column:
    """The bins in which what overlaps the closed interval can stand; it is no longer than ``smallest``."""
    found = [F.array(_bin(LEVELS, F.lit(0)))]
    for level, size in enumerate(_sizes(smallest)):
        first, last = F.floor(b / size), F.floor(e / size)
        found.append(F.when(first == last, F.array(_bin(level, first))).otherwise(F.array(_bin(level, first), _bin(level, last))))
    return F.concat(*found)


def overlapping(windows: DataFrame, intervals: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Pairs of windows (keys, win_start, win_end exclusive, ..) and intervals (keys, b, e closed, ..) that overlap.

    Windows are no longer than ``longest``. An interval in two bins can meet a window twice.
    """
    smallest = 1 << max(longest - 1, 1).bit_length()
    left = windows.withColumn("_bin", F.explode(touched_bins(F.col("win_start"), F.col("win_end") - 1, smallest)))
    right = intervals.withColumn("_bin", F.explode(interval_bins(F.col("b"), F.col("e"), smallest)))
    split = lambda df: df.withColumns({"_level": F.col("_bin.level"), "_number": F.col("_bin.number")}).drop("_bin")
    return split(left).join(split(right), [*keys, "_level", "_number"]).where("e >= win_start AND b < win_end").drop("_level", "_number")
