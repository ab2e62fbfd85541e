"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back, so that what depends on where its rows lie is the same for all readers.

    The folder is spark.checkpoint.dir; one under the warehouse is used only where none is named.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/helixlake-checkpoints"
    path = f"{base.rstrip('/')}/helixlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
