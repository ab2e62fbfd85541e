"""Running values and runs over ordered rows, without a task that holds all rows of a large key.

Keys are hashed to ``BUCKETS``; where a bucket has far more rows than others, the order of its keys, a whole number such
as a position, is cut into blocks. What a block needs of the rows outside comes from a carry table, which has a
row per key and block. Where no bucket is large, which counting shows, keys are groups and nothing is carried; the
rows are the same. Keys are not null, and a key has a row per value of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order in a block.
BLOCK = 1 << 16
#: A bucket is large that has more rows than both HEAVY_ROWS and HEAVY_TIMES the mean.
BUCKETS, HEAVY_ROWS, HEAVY_TIMES = 4096, 1_000_000, 4
#: In place of large buckets: every key is cut into blocks, and nothing is counted.
EVERY = [-1]


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def heavy_buckets(df: DataFrame, keys: list[str]) -> list[int]:
    """The large buckets of keys, from counts by bucket: as many numbers as there are buckets come to the driver."""
    counts = {r["bucket"]: r["n"] for r in df.groupBy(_bucket(keys).alias("bucket")).agg(F.count("*").alias("n")).collect()}
    most = max(HEAVY_ROWS, HEAVY_TIMES * sum(counts.values()) // BUCKETS)
    return sorted(b for b, n in counts.items() if n > most)


def _blocked(df: DataFrame, keys: list[str], order: str, block: int, heavy: list[int]) -> DataFrame:
    """``_block``: number of the block of a large key, null for one that is whole."""
    number = F.floor(F.col(order) / block)
    return df.withColumn("_block", number if heavy == EVERY else F.when(_bucket(keys).isin(heavy), number))


def running(df: DataFrame, keys: list[str], order: str, sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, following: str | None = None, block: int = BLOCK, heavy: list[int] | None = None) -> DataFrame:
    """``df`` with sums and maxima (name: column) over the rows before, null where there are none, and with the
    value of the order in the next row as ``following``. ``heavy``: large buckets, where they are known already."""
    sums, maxima = sums or {}, maxima or {}
    heavy = heavy_buckets(df, keys) if heavy is None else heavy

    def over(frame: DataFrame, within: list[str], by: str, of: dict[str, str], to: dict[str, str], ahead: tuple[str, str] | None) -> DataFrame:
        own = Window.partitionBy(*within).orderBy(by)
        before = own.rowsBetween(Window.unboundedPreceding, -1)
        made = {to[n]: (F.sum if n in sums else F.max)(of[n]).over(before) for n in of}
        if ahead:
            made[ahead[1]] = F.lead(ahead[0]).over(own)
        return frame.withColumns(made)

    named, ahead = sums | maxima, (order, following) if following else None
    if not heavy:
        return over(df, keys, order, named, {n: n for n in named}, ahead)
    blocked = _blocked(df, keys, order, block, heavy)
    local = over(blocked, [*keys, "_block"], order, named, {n: n for n in named}, ahead)
    totals = [(F.sum if n in sums else F.max)(c).alias(f"_of_{n}") for n, c in named.items()]
    ends = blocked.where("_block IS NOT NULL").groupBy(*keys, "_block").agg(*totals, F.min(order).alias("_first"))
    carry = over(ends, keys, "_block", {n: f"_of_{n}" for n in named}, {n: f"_c_{n}" for n in named}, ("_first", "_c_next") if following else None)
    carried = [f"_c_{n}" for n in named] + (["_c_next"] if following else [])
    joined = local.join(carry.select(*keys, "_block", *carried), [*keys, "_block"], "left")
    both = {n: F.when(F.col(n).isNotNull() | F.col(f"_c_{n}").isNotNull(), F.coalesce(n, F.lit(0)) + F.coalesce(f"_c_{n}", F.lit(0))) for n in sums}
    both |= {n: F.greatest(n, f"_c_{n}") for n in maxima}
    if following:
        both[following] = F.coalesce(following, "_c_next")
    return joined.withColumns(both).drop("_block", *carried)


def joined_runs(rows: DataFrame, keys: list[str], touching: bool, block: int = BLOCK, heavy: list[int] | None = None) -> DataFrame:
    """(keys, b, e, label, n): neighbours of equal label as one, ``rows(keys, b, e, label, n)`` in order of b.

    With ``touching`` neighbours join only where the next one begins right after the last. Runs of large keys are made
    inside blocks of b first; those at either end of a block, two of a block at most, are joined over the blocks.
    """
    heavy = heavy_buckets(rows, keys) if heavy is None else heavy
    columns = [*keys, "b", "e", "label", "n"]

    def islands(df: DataFrame, within: list[str], in_block: bool = False) -> DataFrame:
        order = Window.partitionBy(*within).orderBy("b")
        same = F.lag("label").over(order).eqNullSafe(F.col("label")) & F.lag(F.lit(True), 1, False).over(order)
        if touching:
            same = same & (F.lag("e").over(order) + 1).eqNullSafe(F.col("b"))
        if in_block:  # the two ends of one block are apart: runs that join inside it are one already
            same = same & (F.lag("_block").over(order) != F.col("_block"))
        marked = df.withColumn("_new", 1 - same.cast("int"))
        return marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def summed(df: DataFrame, within: list[str]) -> DataFrame:
        return df.groupBy(*within, "_run", "label").agg(F.min("b").alias("b"), F.max("e").alias("e"), F.sum("n").alias("n"))

    if not heavy:
        return summed(islands(rows, keys), keys).select(*columns)
    local = summed(islands(_blocked(rows, keys, "b", block, heavy), [*keys, "_block"]), [*keys, "_block"])
    last = F.max("_run").over(Window.partitionBy(*keys, "_block"))
    local = local.withColumn("_end", F.col("_block").isNotNull() & ((F.col("_run") == 1) | (F.col("_run") == last)))
    edges = summed(islands(local.where("_end").drop("_run"), keys, True), keys)
    return local.where("NOT _end").select(*columns).unionByName(edges.select(*columns))
