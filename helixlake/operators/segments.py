"""From window predictions to segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.functions.numeric import class_of
from helixlake.operators.scan import BLOCK, EVERY, joined_runs

#: Bases that a task works on before rows leave it.
CELLS = 1 << 18
ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64())}


def overlap_mean(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, p0, p1, p2, n): mean of the class probabilities over the rows of a base."""
    return scored.groupBy(*keys, "pos").agg(F.avg("p0").alias("p0"), F.avg("p1").alias("p1"), F.avg("p2").alias("p2"), F.count("*").alias("n"))


def block_starts(contigs: DataFrame, block: int) -> DataFrame:
    """(seqid, ord, block, first, n): the blocks of ``block`` positions of every sequence."""
    starts = F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(block)))
    cut = contigs.where("length > 0").select(F.col("id").alias("seqid"), "ord", "length", starts.alias("first"))
    return cut.select("seqid", "ord", F.floor(F.col("first") / block).cast("int").alias("block"), "first", F.least(F.lit(block), F.col("length") - F.col("first")).cast("int").alias("n"))


def window_sums(wins: pa.RecordBatch, values: np.ndarray, block: int) -> pa.RecordBatch:
    """(seqid, ord, block, first, p0, p1, p2, n) of windows (seqid, ord, win_start, size) that stand in order, whose values
    [class][base] follow each other: cut where blocks end, and neighbours in one block of a sequence added up."""
    starts, sizes = (wins.column(c).to_numpy().astype(np.int64) for c in ("win_start", "size"))
    low, many = starts // block, (starts + sizes - 1) // block - starts // block + 1
    row = np.repeat(np.arange(len(starts)), many)
    number = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    first = np.maximum(starts[row], number * block)
    size = np.minimum((starts + sizes)[row], (number + 1) * block) - first
    meta = wins.select(["seqid", "ord"]).to_pandas()
    same = meta.eq(meta.shift()).all(axis=1).to_numpy()
    begun = np.ones(len(row), dtype=bool)
    begun[1:] = (number[1:] != number[:-1]) | ((row[1:] != row[:-1]) & ~same[row[1:]])
    run, at = np.cumsum(begun) - 1, np.flatnonzero(begun)
    begins = np.minimum.reduceat(first, at)
    spans = np.maximum.reduceat(first + size, at) - begins
    offsets = np.concatenate([[0], np.cumsum(spans)])
    place = np.repeat(offsets[run] + first - begins[run] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    sums = [np.bincount(place, v, offsets[-1]) for v in values] + [np.bincount(place, minlength=offsets[-1]).astype(np.int32)]
    lists = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v)) for v in sums]
    keys = [wins.column(c).take(pa.array(row[at])) for c in ("seqid", "ord")]
    return pa.RecordBatch.from_arrays([*keys, pa.array(number[at].astype(np.int32)), pa.array(begins.astype(np.int32)), *lists], ["seqid", "ord", "block", "first", "p0", "p1", "p2", "n"])


def scored_sums(wins: DataFrame, score: Callable[[pd.DataFrame], np.ndarray], block: int, cells: int = CELLS) -> DataFrame:
    """``window_sums`` of windows (seqid, ord, win_start, size, ..), about ``cells`` bases at once; ``score`` gives [class][base] of some."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.cumsum(batch.column("size").to_numpy().astype(np.int64)) // cells
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    some = batch.slice(a, b - a)
                    yield window_sums(some, score(some.to_pandas()), block)

    kinds = ", ".join(f"{c} {wins.schema[c].dataType.simpleString()}" for c in ("seqid", "ord"))
    return wins.mapInArrow(made, f"{kinds}, block int, first int, p0 array<double>, p1 array<double>, p2 array<double>, n array<int>")


def reduced_blocks(scored: DataFrame, contigs: DataFrame, block: int, columns: str, made: Callable[[int, np.ndarray, np.ndarray], list[tuple]], cells: int = CELLS) -> DataFrame:
    """(seqid, ord, ``columns``): what ``made`` makes of each block of every sequence: its first position, the means
    [class][base] over the windows that hold a base, 0 where none does, and how many do.

    ``scored(ord, seqid, block, first, p0, p1, p2)`` has arrays that end with their block, of one window or, with an array
    ``n`` of how many hold a base, sums of several. They are the one shuffle, dealt by sequence and block; where a block has
    arrived its arrays are added up one after the other. Each block has a row of its own with its size, so that no base is
    missing. Rows leave a task when blocks of about ``cells`` bases are done.
    """
    none, many = F.array().cast("array<double>"), F.array().cast("array<int>")
    sizes = block_starts(contigs, block).select("seqid", "ord", "block", F.lit(0).alias("w"), F.col("n").cast("long").alias("first"), none.alias("p0"), none.alias("p1"), none.alias("p2"), many.alias("n"))
    held = F.col("n").cast("array<int>") if "n" in scored.columns else many
    arrays = scored.select("seqid", "ord", "block", F.lit(1).alias("w"), F.col("first").cast("long").alias("first"), "p0", "p1", "p2", held.alias("n")).unionByName(sizes)
    dealt = arrays.repartition("seqid", "ord", "block").sortWithinPartitions("seqid", "ord", "block", "w")
    kinds = [f"{c} {arrays.schema[c].dataType.simpleString()}" for c in ("seqid", "ord")]
    made_columns = [c.split() for c in columns.split(", ")]

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, sums, n, done, bases, types = None, 0, np.zeros((3, block)), np.zeros(block, dtype=np.int64), [], 0, []

        def finish() -> None:
            if key is not None:
                done.extend((*key[:2], *row) for row in made(key[2] * block, sums[:, :size] / np.maximum(n[:size], 1), n[:size].copy()))

        def frame() -> pa.RecordBatch:
            every = [*types, *(ARROW[kind] for _, kind in made_columns)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), every)], ["seqid", "ord", *(name for name, _ in made_columns)])

        for batch in batches:
            types = [batch.schema.field(c).type for c in ("seqid", "ord")]
            keys = zip(batch.column("seqid").to_pylist(), batch.column("ord").to_pylist(), batch.column("block").to_pylist())
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in map(batch.column, ("p0", "p1", "p2"))]
            ends, held = batch.column("n").offsets.to_numpy(), batch.column("n").values.to_numpy()
            for k, (mine, w, first) in enumerate(zip(keys, batch.column("w").to_pylist(), batch.column("first").to_pylist())):
                if key != mine:
                    finish()
                    bases += size
                    if bases >= cells:
                        if done:
                            yield frame()
                        done, bases = [], 0
                    key, size = mine, 0
                    sums[:], n[:] = 0, 0
                if w == 0:
                    size = first
                    continue
                at = first - mine[2] * block
                for total, (offsets, values) in zip(sums, lists):
                    end = at + offsets[k + 1] - offsets[k]
                    total[at:end] += values[offsets[k] : offsets[k + 1]]
                n[at:end] += held[ends[k] : ends[k + 1]] if ends[k + 1] > ends[k] else 1
        finish()
        if done:
            yield frame()

    return dealt.mapInArrow(reduced, ", ".join([*kinds, columns]))


def block_means(scored: DataFrame, contigs: DataFrame, block: int) -> DataFrame:
    """(seqid, ord, pos, p0, p1, p2, n): means over the windows that hold a base, a row per base of every sequence;
    bases in no window have probabilities of 0. ``scored`` as ``reduced_blocks`` takes it."""
    whole = lambda first, means, n: [(first, *means, n)]
    arrays = reduced_blocks(scored, contigs, block, "first bigint, p0 array<double>, p1 array<double>, p2 array<double>, n array<bigint>", whole)
    flat = arrays.select("seqid", "ord", "first", F.posexplode(F.arrays_zip("p0", "p1", "p2", "n")).alias("k", "p"))
    position = (F.col("first") + F.col("k")).cast(scored.schema["first"].dataType)
    return flat.select("seqid", "ord", position.alias("pos"), "p.p0", "p.p1", "p.p2", "p.n")


def classes(p: np.ndarray) -> np.ndarray:
    """``class_of`` of arrays: ties and NaN go to the lowest class."""
    one = p[1] > p[0]
    return np.where(p[2] > np.where(one, p[1], p[0]), 2, np.where(one, 1, 0))


def mean_segments(scored: DataFrame, contigs: DataFrame, block: int) -> DataFrame:
    """``segments`` of the means of ``scored``, without a row per base: runs are found where a block has arrived, and those of
    neighbouring blocks joined."""

    def runs_of(first: int, means: np.ndarray, n: np.ndarray) -> list[tuple]:
        label = classes(means)
        starts = np.flatnonzero(np.diff(label, prepend=-1))
        ends = np.append(starts[1:], len(label)) - 1
        return [(first + int(b), first + int(e), int(label[b]), 1) for b, e in zip(starts, ends)]

    kind = scored.schema["first"].dataType.simpleString()
    found = reduced_blocks(scored, contigs, block, f"b {kind}, e {kind}, label int, n int", runs_of)
    joined = joined_runs(found, ["seqid", "ord"], touching=True, block=100_000, heavy=EVERY)
    return joined.select("seqid", "ord", (F.col("b") + 1).alias("start"), (F.col("e") + 1).alias("end"), "label")


def runs(labelled: DataFrame, keys: list[str], order: str = "pos", label: str = "label", block: int = BLOCK) -> DataFrame:
    """(keys, label, first, last, n): maximal runs of equal labels in order, a whole number that differs by row.

    Inside blocks of the order first, then over the ends of the blocks, where a key holds very many rows.
    """
    rows = labelled.select(*keys, F.col(order).alias("b"), F.col(order).alias("e"), F.col(label).alias("label"), F.lit(1).cast("long").alias("n"))
    found = joined_runs(rows, keys, touching=False, block=block)
    return found.select(*keys, F.col("label").alias(label), F.col("b").alias("first"), F.col("e").alias("last"), "n")


def block_runs(labelled: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, b, e, label): runs of positions that follow each other, in blocks of them whatever the keys: rows that
    take a model to make are not made once more to be counted."""
    rows = labelled.select(*keys, F.col("pos").alias("b"), F.col("pos").alias("e"), "label", F.lit(1).alias("n"))
    return joined_runs(rows, keys, touching=True, block=block, heavy=EVERY).select(*keys, "b", "e", "label")


def segments(predictions: DataFrame, block: int = 100_000) -> DataFrame:
    """(seqid, ord, start, end, label): 1-based inclusive runs of the most probable class."""
    named = predictions.withColumn("label", class_of(F.col("p0"), F.col("p1"), F.col("p2")))
    found = block_runs(named, ["seqid", "ord"], block)
    return found.select("seqid", "ord", (F.col("b") + 1).alias("start"), (F.col("e") + 1).alias("end"), "label")
