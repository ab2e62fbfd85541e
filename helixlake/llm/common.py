"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions.binding import let

__all__ = ["discard", "let", "match_spans", "positions", "release", "running_sums", "stored", "table", "texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positions(first: Column, last: Column) -> Column:
    """The integers first..last, none if last < first (``sequence`` alone would count down)."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def texts(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: its lineage ends there.

    The folder comes from spark.checkpoint.dir; one under the warehouse is set only where none is
    named, as in tests. The files carry their own schema, so a lost executor costs a reread only.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/helixlake-checkpoints"
    path = f"{base.rstrip('/')}/helixlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a ``stored`` frame that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/helixlake-" in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            with contextlib.suppress(Exception):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that are over: it does so when the driver's garbage
    collection finds them unused, which on a driver with a roomy heap may be long after the disks are full."""
    for _ in range(2):  # the first finds the plans that hold them
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def running_sums(values: Column, block: int = 256) -> Column:
    """Inclusive running sums of an array<bigint>, in blocks, so that long arrays stay cheap."""
    none = F.array().cast("array<bigint>")

    def summed(part: Column, start: Column) -> Column:
        return F.aggregate(
            part, none, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.element_at(F.concat(F.array(start), acc), -1), F.lit(0)) + v))
        )

    zero = F.lit(0).cast("bigint")
    parts = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(block)), lambda s: s <= F.size(values)),
        lambda s: summed(F.slice(values, s, block), zero),
    )
    return let(
        parts,
        lambda ps: let(
            summed(F.transform(ps, lambda p: F.element_at(p, -1)), zero),
            lambda ends: F.flatten(
                F.transform(ps, lambda p, k: let(F.when(k > 0, F.get(ends, k - 1)).otherwise(zero), lambda before: F.transform(p, lambda v: v + before)))
            ),
        ),
    )


def match_spans(text: Column, pattern: str, group: int = 0, keep=None) -> Column:
    """Leftmost non-overlapping matches of a Java regex as array<struct<start,end,value>>.

    Code points, end exclusive; ``value`` is the given group and ``keep(span length, value)`` decides
    which matches stay. The pattern must not match the empty string.
    """
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    kept = keep or (lambda length, value: F.lit(True))

    def spans(ms: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, 1, F.size(ms)), ms, lambda g, m: (F.length(g) + F.length(m)).cast("bigint"))
        made = let(
            running_sums(lengths),
            lambda ends: F.zip_with(
                F.zip_with(ends, ms, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"))),
                values,
                lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), v.alias("value")),
            ),
        )
        return F.filter(made, lambda s: kept(s["end"] - s["start"], s["value"]))

    kind = "array<struct<start:bigint,end:bigint,value:string>>"
    return let(whole, lambda ms: F.when(F.size(ms) > 0, spans(ms).cast(kind)).otherwise(F.array().cast(kind)))
