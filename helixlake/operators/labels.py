"""Base labels from annotations: intervals of exons, gaps between them as introns, priority painting.

Labels: 0 intergenic, 1 intron, 2 exon. Intervals stay intervals as long as they can; only consumers
that need a row per base expand them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from helixlake.functions.attributes import parents
from helixlake.operators.scan import BLOCK, heavy_buckets, joined_runs, running

EXON_FEATURES = ("CDS", "exon")
INTRON, EXON = 1, 2
#: Positions of a sequence that are made from one array.
LINE_BLOCK = 10_000
#: Positions that a task paints: the number of tasks follows the positions.
CELLS = 1 << 19


def stranded(features: DataFrame) -> DataFrame:
    """A feature of strand ``.`` counts on both strands; other marks than + and - on none."""
    strands = F.when(F.col("strand") == ".", F.array(F.lit("+"), F.lit("-"))).otherwise(F.array("strand"))
    return features.withColumn("strand", F.explode(strands)).where(F.col("strand").isin("+", "-"))


def exon_intervals(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """(seqid, strand, attributes, b, e): coding features as 0-based closed intervals inside their sequence.

    ``contigs(id, length)`` is joined on the id; Spark broadcasts it while it is small.
    """
    named = features.where(F.col("feature").isin(*EXON_FEATURES))
    inside = stranded(named).join(contigs.select(F.col("id").alias("seqid"), "length").distinct(), "seqid")
    b, e = F.greatest(F.col("start") - 1, F.lit(0)), F.least(F.col("end") - 1, F.col("length") - 1)
    return inside.select("seqid", "strand", "attributes", b.alias("b"), e.alias("e")).where("e >= b")


def transcripts(exons: DataFrame) -> DataFrame:
    """(seqid, strand, tx, b, e): an exon for each transcript that names it."""
    return exons.select("seqid", "strand", F.explode(parents(F.col("attributes"))).alias("tx"), "b", "e")


def gaps(intervals: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, b, e): what lies between an interval and the furthest end before it, in order of (b, e).

    Where a key holds very many rows its starts are cut into blocks. Of intervals that begin together the first alone
    can follow a gap, so that there one row per start is enough.
    """
    known = intervals.where("e >= b").select(*keys, "b", "e")
    heavy = heavy_buckets(known, keys)
    starts = known.groupBy(*keys, "b").agg(F.max("e").alias("e")) if heavy else known
    reached = running(starts, keys, "b", maxima={"reached": "e"}, block=block, heavy=heavy)
    cut = reached.select(*keys, (F.col("reached") + 1).alias("b"), (F.col("b") - 1).alias("e"))
    return cut.where("e >= b")


def label_intervals(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """(seqid, strand, b, e, label): every exon and every intron, overlapping as they come."""
    exons = exon_intervals(features, contigs)
    introns = gaps(transcripts(exons), ["seqid", "strand", "tx"])
    exon = exons.select("seqid", "strand", "b", "e", F.lit(EXON).alias("label"))
    return exon.unionByName(introns.select("seqid", "strand", "b", "e", F.lit(INTRON).alias("label")))


def paint(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, label): the greatest label that covers a position; a row per covered position.

    Intervals are dealt by block of positions, and positions made where a block has arrived, about ``CELLS`` in a task.
    """
    spans = intervals.groupBy(*keys).agg((F.max("e") - F.min("b") + 1).alias("span"), F.sum(F.col("e") - F.col("b") + 1).alias("sum"))
    cells = spans.agg(F.sum(F.least("span", "sum").cast("double"))).first()[0]
    return _positions(intervals.select(*keys, "b", "e", "label"), keys, cells).agg(F.max("label").alias("label")).drop("_block")


def _positions(intervals: DataFrame, keys: list[str], cells: float | None) -> GroupedData:
    """The positions of the intervals, about ``cells`` in all, by key, block and position."""
    tasks = max(intervals.sparkSession.sparkContext.defaultParallelism, math.ceil((cells or 0) / CELLS))
    kind = intervals.schema["b"].dataType
    of = lambda end: F.floor(F.col(end) / LINE_BLOCK).cast("bigint")
    cut = intervals.withColumn("_block", F.explode(F.sequence(of("b"), of("e"))))
    first = F.col("_block") * LINE_BLOCK
    cut = cut.withColumns({"b": F.greatest("b", first).cast(kind), "e": F.least("e", first + LINE_BLOCK - 1).cast(kind)})
    dealt = cut.repartition(tasks, *keys, "_block")
    return dealt.withColumn("pos", F.explode(F.sequence("b", "e"))).groupBy(*keys, "_block", "pos")


def label_runs(intervals: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, b, e, label): painting without a row per position.

    The ends of the intervals cut the line into pieces over which the covering labels don't change;
    running counts of open exons and introns give each piece its label, and equal neighbours merge.
    Work follows the number of intervals, however long they are, in blocks of positions with a carry table.
    """
    opened = intervals.select(*keys, F.col("b").alias("at"), "label", F.lit(1).alias("d"))
    closed = intervals.select(*keys, (F.col("e") + 1).alias("at"), "label", F.lit(-1).alias("d"))
    both = opened.unionByName(closed)
    count = lambda label: F.sum(F.when(F.col("label") == label, F.col("d")).otherwise(0))
    edges = both.groupBy(*keys, "at").agg(count(EXON).alias("d2"), count(INTRON).alias("d1"))
    heavy = heavy_buckets(intervals, keys)
    counted = running(edges, keys, "at", sums={"n2": "d2", "n1": "d1"}, following="next", block=block, heavy=heavy)
    opened = lambda n, d: F.coalesce(n, F.lit(0)) + F.col(d)
    label = F.when(opened("n2", "d2") > 0, EXON).when(opened("n1", "d1") > 0, INTRON).otherwise(0)
    pieces = counted.select(*keys, F.col("at").alias("b"), (F.col("next") - 1).alias("e"), label.alias("label")).where("e IS NOT NULL AND label > 0")
    return merged(pieces, keys, "b", block, heavy)


def merged(pieces: DataFrame, keys: list[str], order_by: str, block: int = BLOCK, heavy: list[int] | None = None) -> DataFrame:
    """(keys, b, e, label): adjacent pieces of equal label as one."""
    rows = pieces.select(*keys, F.col(order_by).alias("b"), "e", "label", F.lit(1).alias("n"))
    return joined_runs(rows, keys, touching=True, block=block, heavy=heavy).select(*keys, "b", "e", "label")


def dense_labels(intervals: DataFrame, contigs: DataFrame, strands: tuple[str, ...] = ("+", "-")) -> DataFrame:
    """(seqid, strand, pos, label): a row per base and strand, 0 where nothing covers it.

    The line of a sequence is painted like its intervals, so that bases are made once and not joined.
    """
    held = contigs.where("length > 0").select(F.col("id").alias("seqid"), F.explode(F.array(*map(F.lit, strands))).alias("strand"), "length")
    cells = held.agg(F.sum(F.col("length").cast("double"))).first()[0]
    kind = intervals.schema["label"].dataType
    line = held.select("seqid", "strand", F.lit(0).alias("b"), (F.col("length") - 1).alias("e"), F.lit(None).cast(kind).alias("label"), F.lit(1).alias("line"))
    both = line.unionByName(intervals.select("seqid", "strand", "b", "e", "label", F.lit(0).alias("line")))
    painted = _positions(both, ["seqid", "strand"], cells).agg(F.max("label").alias("label"), F.sum("line").cast("int").alias("line"))
    # a row per sequence of an id; intervals beyond the line or of no sequence have none
    each = painted.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("line"))))
    return each.select("seqid", "strand", F.col("pos").cast(contigs.schema["length"].dataType).alias("pos"), F.coalesce("label", F.lit(0)).alias("label"))


def class_counts(runs: DataFrame, contigs: DataFrame) -> DataFrame:
    """(seqid, strand, intergenic, intron, exon): bases of each class, from runs."""
    strands = contigs.select(F.col("id").alias("seqid"), "length", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"))
    size = lambda label: F.coalesce(F.sum(F.when(F.col("label") == label, F.col("e") - F.col("b") + 1)), F.lit(0))
    summed = runs.groupBy("seqid", "strand").agg(size(INTRON).alias("intron"), size(EXON).alias("exon"))
    joined = strands.join(summed, ["seqid", "strand"], "left").na.fill(0, ["intron", "exon"])
    return joined.select("seqid", "strand", (F.col("length") - F.col("intron") - F.col("exon")).alias("intergenic"), "intron", "exon")


def flipped(labels: DataFrame, length: str = "length") -> DataFrame:
    """Positions counted from the other end, as the reverse strand reads them."""
    return labels.withColumn("pos", F.col(length) - 1 - F.col("pos"))
