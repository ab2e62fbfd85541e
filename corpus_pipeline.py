"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the
columns of ``documents``; the last returns counts and digests of the tokens. Stages read the labels
and the benchmark beside the documents, and nothing else.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import bpe, decontam, linedup, omh, quality
from helixlake.llm.common import stored, table
from helixlake.llm.queries import RANKS


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that a learned rule rejects go.

    A null or empty text has no words and goes. Rows that repeat stay or go together; columns named as statistics
    keep their values. Without labels the base rules decide alone.
    """
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct("*").alias("_row"), "text")  # columns named as statistics stay as they are
    return quality.judged(whole, rules).where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier one are cut; n_chars follows the text.

    A null text stays null. Rows of one id and text count as one and lose the same lines; texts that share an id are
    told apart, null ids come first. A document all of whose lines are cut stays, with an empty text.
    """
    cut = "_cut"
    while cut in (c.lower() for c in docs.columns):  # a column of the documents keeps its name and values
        cut += "_"
    made = linedup.deduplicated(docs, removed=cut)
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        made = made.withColumn("n_chars", F.when(F.size(cut) > 0, n).otherwise(F.col("n_chars")))
    return made.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of the least id, then of the least MD5 of its text.

    Rows of a null id or text stay. Repeated rows of the one that stays are one row.
    """
    return omh.deduplicated(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go: all rows of their id, of a null id those of the text alone.

    A null or empty text holds no passage and stays; an empty benchmark leaves all.
    """
    return decontam.without_overlaps(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document, encoded and decoded again; a null text has no tokens."""
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("tokens", tokens),
]

#: The learned rules and the sketches have no SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
