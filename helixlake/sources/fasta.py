"""FASTA scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.sources.scratch import kept


def _numbered(blocks: DataFrame) -> DataFrame:
    """``blocks(file, block, size)`` with ``before``: the sizes of all blocks before, in order of file and block.

    Blocks are dealt by range and counted inside a range; what lies before a range is a sum of a row per range.
    """
    ranged = blocks.repartitionByRange("file", "block").withColumn("_range", F.spark_partition_id())
    ranged = kept(ranged, "fasta-blocks")  # the ranges are drawn from samples: both readers below need the same
    inside = Window.partitionBy("_range").orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("_range").agg(F.sum("size").alias("size"))
    line = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = ranges.select("_range", F.coalesce(F.sum("size").over(line), F.lit(0)).alias("_offset"))
    local = ranged.withColumn("_local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(F.broadcast(offsets), "_range").withColumn("before", F.col("_offset") + F.col("_local")).drop("_range", "_offset", "_local")


def _records(chunks: DataFrame, strip_whitespace: bool) -> DataFrame:
    """(ord, id, seq, length) of the chunks (file, block, at, value) between the marks of records.

    ``at`` orders the chunks of a block without gaps. The first chunk of a file is a record only if it
    starts with a mark itself. Records are numbered over all files, in order of their names, by the counts of
    the blocks: a table of a row per block, while the sequences stay where they were read.
    """
    opens = F.min_by(F.startswith("value", F.lit(">")), "at")
    blocks = chunks.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("start"), opens.alias("opens"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("block")) == 1
    counted = blocks.withColumn("first", first).withColumn("skip", (F.col("first") & ~F.col("opens")).cast("int"))
    numbered = _numbered(counted.withColumn("size", F.col("n") - F.col("skip")))
    placed = numbered.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "start", "skip", "first", "before")
    joined = chunks.join(placed, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    at = F.col("at") - F.col("start")
    kept = joined.where(~((F.col("skip") == 1) & (at == 0)))
    record = F.when(F.col("first") & (at == 0), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    named = kept.select((F.col("before") + at - F.col("skip")).cast("long").alias("ord"), record.alias("record"))
    head = F.regexp_extract("record", r"^([^\s]*)", 1)
    body = F.when(F.instr("record", F.lit("\n")) > 0, F.regexp_replace("record", r"^[^\n]*\n", "")).otherwise("")
    seq = F.regexp_replace(body, r"\r*(\n|$)", "")
    if strip_whitespace:
        seq = F.regexp_replace(seq, r"\s", "")
    return named.select("ord", head.alias("id"), seq.alias("seq")).withColumn("length", F.length("seq"))


def parse_fasta(files: DataFrame, strip_whitespace: bool = False) -> DataFrame:
    """(ord, id, seq, length) of the records of FASTA texts, ``files(value)`` with one text per row; with a
    column ``file``, its order is that of the texts.

    ``>`` at the start of a line begins a record, whose id runs to the first white space; text before
    the first record is ignored; lines lose their line ends only, so blanks inside a line stay bases,
    unless ``strip_whitespace``. Empty records and duplicate ids are kept; ``ord`` tells records apart.
    """
    file = F.col("file") if "file" in files.columns else F.lit("")
    chunks = files.select(file.alias("file"), F.posexplode(F.split("value", "\n>")).alias("at", "value"))
    return _records(chunks.select("file", F.lit(0).alias("block"), "at", "value"), strip_whitespace)


def read_fasta(spark: SparkSession, path: str, strip_whitespace: bool = False) -> DataFrame:
    """The records of one or many files, as ``parse_fasta`` gives them.

    A row is a record from the start: files are split between records, whatever their size. A sequence has to
    stay below 2 GB.
    """
    read = spark.read.option("lineSep", "\n>").text(path)
    chunks = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return _records(chunks, strip_whitespace)
