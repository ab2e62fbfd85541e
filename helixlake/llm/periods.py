"""Periodic runs of words: power-of-two names, common extensions by descending names, candidates on a grid.

Names follow Karp, Miller and Rosenberg: at level k two places of a text have one name if the same 2^k words stand
there, made from the pairs of names of the level before. A place whose words stand nowhere else in its text keeps a
name of its own and is not looked at again, so that a text costs little beyond its repetitions. For each period q
places 2q apart are compared with those q words on; a run of four periods holds one at which at least q words agree, so
that one name decides. What agrees is extended both ways by descending levels.

Defined results: a null or empty text has no words and no runs; rows that repeat have the same runs; further columns
stay, but for those named like the two that are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Words of texts that are worked on together, and candidates compared at once. A longer text is worked on alone.
SLICE_WORDS, CANDIDATES = 1 << 17, 1 << 20

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        made = self[word] = len(self)
        return made


def _named(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names of ``size`` places: equal, from 0, where keys of the places ``at`` repeat, else below 0 and unique."""
    out = -1 - np.arange(size, dtype=np.int32)
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.r_[True, ranked[1:] != ranked[:-1]]
    twice = ~fresh
    twice[:-1] |= ~fresh[1:]
    out[at[order[twice]]] = np.cumsum(fresh)[twice]
    return out


def names(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """[level][place]: names of the 2^level words from a place on, of its text alone, as long as any repeat."""
    size, at = len(ids), np.arange(len(ids))
    levels, keys, span = [], text.astype(np.int64) << 32 | ids, 1
    while len(at):
        levels.append(_named(keys, at, size))
        last = levels[-1]
        at = np.flatnonzero((last[: size - span] >= 0) & (last[span:] >= 0) & (text[: size - span] == text[span:])) if span < size else at[:0]
        keys = last[at].astype(np.int64) << 32 | last[at + span]
        span *= 2
    return np.stack(levels)


def extents(levels: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from the places i and j on, and how many before them."""
    size = levels.shape[1]
    a, b, c, d = i.copy(), j.copy(), i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        step, named = 1 << k, levels[k]
        same = (b < size) & (named[np.minimum(a, size - 1)] == named[np.minimum(b, size - 1)])
        a, b = a + same * step, b + same * step
        same = (c >= step) & (named[np.maximum(c - step, 0)] == named[np.maximum(d - step, 0)])
        c, d = c - same * step, d - same * step
    return a - i, i - c


def runs_of(ids: np.ndarray, text: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """[start, end, period] of all runs, by start and period; ``first`` and ``n`` of each text in the flat ``ids``."""
    if not len(ids):
        return np.empty((0, 3), dtype=np.int64)
    levels = names(ids, text)
    # the deepest level of each text bounds its periods: a run of period q repeats 2^floor(log2 q) words
    deepest = np.full(len(n), -1, dtype=np.int64)
    for k, named in enumerate(levels):
        deepest[np.unique(text[named >= 0])] = k
    longest = np.minimum(n // LEAST_PERIODS, (1 << deepest + 1) - 1)
    at = np.repeat(np.arange(len(n)), longest)
    q = np.arange(len(at)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    grid = -(-(n[at] - q) // (2 * q))
    ends, out, done = np.cumsum(grid), [], 0
    while done < len(at):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CANDIDATES, "right")))
        many = grid[done:upto]
        period = np.repeat(q[done:upto], many)
        step = np.arange(len(period)) - np.repeat(np.cumsum(many) - many, many)
        g = np.repeat(first[at[done:upto]], many) + 2 * period * step
        level = np.frexp(period)[1] - 1
        hit = levels[level, g] == levels[level, g + period]
        g, period, done = g[hit], period[hit], upto
        ahead, before = extents(levels, g, g + period)
        start, end = g - before, g + period + ahead
        kept = end - start >= np.maximum(LEAST_LENGTH, LEAST_PERIODS * period)
        out.append(np.stack([start[kept], end[kept], period[kept]], axis=1))
    found = np.concatenate(out) if out else np.empty((0, 3), dtype=np.int64)
    found = found[np.lexsort(found.T[[2, 1, 0]])]
    # a multiple of a run's period has the same ends: the smallest one stays
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[fresh]
    return found[np.lexsort(found.T[[2, 0]])]


def _worked(texts: list[list[bytes]]) -> Iterator[tuple[list[dict[str, int]], str]]:
    n = np.array([len(ws) for ws in texts], dtype=np.int64)
    first, ids = np.cumsum(n) - n, _Ids()
    flat = np.fromiter((i for ws in texts for i in map(ids.__getitem__, ws)), dtype=np.int64, count=int(n.sum()))
    found = runs_of(flat, np.repeat(np.arange(len(n)), n), first, n)
    of = np.searchsorted(first + n, found[:, 0], "right")
    edges = np.searchsorted(of, np.arange(len(n) + 1))
    for k, ws in enumerate(texts):
        own = found[edges[k] : edges[k + 1]]
        if not len(own):
            yield [], b" ".join(ws).decode()
            continue
        shown = [{"start": int(s - first[k]), "length": int(e - s), "period": int(q)} for s, e, q in own]
        dropped = np.zeros(len(ws) + 1, dtype=np.int64)
        np.add.at(dropped, own[:, 0] + own[:, 2] - first[k], 1)
        np.add.at(dropped, own[:, 1] - first[k], -1)
        yield shown, b" ".join(w for w, d in zip(ws, np.cumsum(dropped)) if not d).decode()


@F.pandas_udf(FOUND)
def _periodic(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made, some, size = [], [], 0
        for text in batch:
            some.append(text.encode().split())  # bytes split at the six blanks of ASCII alone
            size += len(some[-1])
            if size >= SLICE_WORDS:
                made += _worked(some)
                some, size = [], 0
        made += _worked(some)
        yield pd.DataFrame({"runs": [r for r, _ in made], "collapsed": [c for _, c in made]})


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed``.

    ``runs`` are the stretches of words with smallest period q, of at least 6 words and 4 q, that no neighbouring word
    extends, by start and period; ``collapsed`` has the words, joined by blanks, that stand in no run after its first
    q words.
    """
    found = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), _periodic(F.coalesce(docs[text].cast("string"), F.lit(""))).alias("_found"))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    return found.select(*kept, F.col("_found.runs").alias("runs"), F.col("_found.collapsed").alias("collapsed"))
