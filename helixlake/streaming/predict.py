"""Prediction of sequences as their files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from helixlake.plans import kernels
from helixlake.plans.annotate import predicted_segments
from helixlake.sources.config import Config
from helixlake.sources.fasta import parse_fasta


def predict_stream(spark: SparkSession, folder: str, params: kernels.Params, config: Config, out: str, checkpoint: str) -> StreamingQuery:
    """Segments of every FASTA file that appears in ``folder``, appended to Parquet under ``out``.

    Sequences don't reach across files, so each micro-batch is predicted by itself and no state is
    kept. A batch that is run again after a failure replaces its own output only.
    """
    files = spark.readStream.schema("value string").text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))

    def batch(arrived: DataFrame, number: int) -> None:
        contigs = parse_fasta(arrived).persist()
        predicted_segments(contigs, params, config).write.mode("overwrite").parquet(f"{out}/batch={number}")
        contigs.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
