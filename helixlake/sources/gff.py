"""GFF3 scans and the text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions.attributes import trimmed


def parse_gff(lines: DataFrame) -> DataFrame:
    """(seqid, source, feature, start, end, strand, attributes) of GFF lines, ``lines(value)``.

    Lines that are empty or start with # are skipped, as are those of fewer than 8 columns; a 10th
    column is cut off. Numbers are read as far as they go, else 0. Coordinates are 1-based, inclusive.
    """
    t = F.split("value", "\t")
    number = lambda k: F.coalesce(F.regexp_extract(F.get(t, F.lit(k)), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    kept = lines.where(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).where(F.size(t) >= 8)
    return kept.select(
        F.get(t, F.lit(0)).alias("seqid"),
        F.get(t, F.lit(1)).alias("source"),
        F.get(t, F.lit(2)).alias("feature"),
        number(3).alias("start"),
        number(4).alias("end"),
        F.substring(F.get(t, F.lit(6)), 1, 1).alias("strand"),
        trimmed(F.coalesce(F.get(t, F.lit(8)), F.lit(""))).alias("attributes"),
    )


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff(spark.read.text(path))


def gff_lines(segments: DataFrame, source: str, id_prefix: str, unique_ids: bool = False) -> DataFrame:
    """(ord, start, value): GFF3 lines of segments (seqid, ord, start, end, label), 1-based inclusive.

    Labels other than intron and exon have no line. The strand is always +; ids are those of the
    sequence, so they repeat, unless ``unique_ids`` adds the start.
    """
    feature = F.when(F.col("label") == 2, "exon").when(F.col("label") == 1, "intron")
    ident = F.concat(F.lit(f"ID={id_prefix}"), F.col("ord").cast("string"), *([F.lit("_"), F.col("start").cast("string")] if unique_ids else []))
    value = F.concat_ws("\t", "seqid", F.lit(source), feature, F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("."), ident)
    return segments.where("label > 0").select("ord", "start", value.alias("value"))


def write_gff(segments: DataFrame, path: str, source: str = "helixlake", id_prefix: str = "pred_", unique_ids: bool = False) -> None:
    """Range-partitioned by sequence and position: the files, in order of name, are the whole in order, the
    header first."""
    spark = segments.sparkSession
    head = spark.createDataFrame([(-1, 0, "##gff-version 3")], "ord int, start int, value string")
    rows = head.unionByName(gff_lines(segments, source, id_prefix, unique_ids))
    rows.orderBy("ord", "start").select("value").write.mode("overwrite").text(path)


def c_rounded(p, digits: int = 4):
    """printf's fixed-point form: the exact binary value decides, exact halves go to the even digit.

    ``format_string`` rounds the shortest decimal form half up, which differs at ties. Here the error of
    the product with the power of ten is computed exactly, by splitting the value in two halves of bits.
    """
    unit = F.lit(float(10**digits))
    scaled = p * unit
    high = p * 134217729.0 - (p * 134217729.0 - p)
    error = (high * unit - scaled) + (p - high) * unit
    low = F.floor(scaled)
    rest = scaled - low
    up = (rest > 0.5) | (rest == 0.5) & ((error > 0) | (error == 0) & (low % 2 == 1))
    return (low + up.cast("int")) / unit


def bedgraph_lines(predictions: DataFrame) -> DataFrame:
    """(ord, pos, value): a line per base, 0-based half-open, probability of exon with four digits."""
    value = F.format_string("%s\t%d\t%d\t%.4f", "seqid", "pos", F.col("pos") + 1, c_rounded(F.col("p2")))
    return predictions.select("ord", "pos", value.alias("value"))


def write_bedgraph(predictions: DataFrame, path: str) -> None:
    """Range-partitioned by sequence and position: the files, in order of name, are the whole in order."""
    bedgraph_lines(predictions).orderBy("ord", "pos").select("value").write.mode("overwrite").text(path)
